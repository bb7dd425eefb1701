"""Similarity joins and leader clustering, exact and without a bound on group sizes.

Leader clustering: records are visited in order; one that no earlier leader resembles becomes a
leader, any other joins the first leader that it resembles. The leaders are the first maximal
independent set of the similarity graph, which a few rounds over its edges give: a record without
undecided earlier neighbours leads, its neighbours are covered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle, unsent

BLOCK_ROWS = 4000  # nodes of a group up to which one task compares every two vectors
BLOCKS, BLOCK_MOST = 8, 100_000  # blocks of a larger group, and nodes of a block from which there are more
COMPARED = 2000  # nodes of a group up to which every two hashes are compared
_NEAR = 1e-5


def _bands(most: int, rows: int, bits: int) -> tuple[list[tuple[int, int]], int]:
    """Cuts of a hash and on how many of them two hashes must agree to be compared.

    With ``most + r`` bands, two hashes at most ``most`` bits apart agree on ``r`` bands at least,
    so every combination of ``r`` bands finds each pair. More bands mean more sorts but fewer
    chance meetings; the cheapest ``r`` for this number of rows is taken.
    """

    def cost(r: int) -> float:
        return math.comb(most + r, r) * (30 + rows / 2.0 ** (bits * r / (most + r)))

    r = min((r for r in (1, 2, 3) if most + r <= bits), key=cost, default=1)
    n = min(most + r, bits)
    cuts = [round(k * bits / n) for k in range(n + 1)]
    return list(zip(cuts, cuts[1:])), r


def _mask(lo: int, hi: int) -> int:
    """Bits ``lo`` to ``hi`` as a signed long."""
    m = (1 << hi) - (1 << lo)
    return m - (1 << 64) if m >= 1 << 63 else m


def _cells(batches, keys: int, rows: int):
    """Tables of whole cells, about ``rows`` rows each, of batches sorted by their first ``keys`` columns (longs)."""
    held, count = [], 0

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        ids = [table.column(k).to_numpy() for k in range(keys)]
        same = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
        return table, int(same[-1]) + 1 if len(same) else 0

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            table, cut = whole()
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
            # a cell larger than this is looked at again only when it has doubled
            count = 0 if not cut else sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each run of equal keys."""
    n = len(sorted_keys[0])
    begin = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]) if n else np.zeros(0, np.int64)
    return begin, np.r_[begin[1:], n] if n else begin


def _close(h: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int):
    """Pairs of positions within each run whose hashes differ in at most ``most`` bits."""
    h, size = h.view(np.uint64), end - begin  # of signed numbers the bits of the absolute value would count
    short = np.flatnonzero((size > 1) & (size <= 64))
    stop = np.repeat(end[short], size[short])
    at = stop - (np.arange(len(stop)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])) - 1
    d = 1
    while len(at):
        open_ = at + d < stop
        at, stop = at[open_], stop[open_]
        hit = at[np.bitwise_count(h[at] ^ h[at + d]) <= most]
        if len(hit):
            yield hit, hit + d
        d += 1
    for r in np.flatnonzero(size > 64):
        e = int(end[r])
        s = int(begin[r])
        while s < e:
            f = min(e, s + max(1, (1 << 19) // (e - s)))
            i, j = np.nonzero(np.bitwise_count(h[s:f, None] ^ h[None, s:e]) <= most)
            later = i < j
            yield i[later] + s, j[later] + s
            s = f


def _near_hashes(nodes: DataFrame, most: int, keys: Sequence[str], bits: int, compared: int) -> DataFrame:
    """(``keys``, ``i``, ``j``) of nodes (``keys``, ``n``, ``bits`` and, with two sides, ``side`` and ``t``) at most ``most`` bits apart.

    Of groups of up to ``compared`` nodes every two are compared. Larger ones go once to each of
    ``most + 1`` cells, by the first of the bands on which a pair can agree; further bands are
    looked up inside the cell, so the shuffle doesn't grow with their combinations. With sides,
    ``i`` is of side 0 and ``j`` of side 1, and their ``t`` come too (``ti``, ``tj``).
    """
    two = "side" in nodes.columns
    groups = nodes.groupBy(*keys).agg(F.count("*").alias("_rows"), *([F.count_distinct("side").alias("_sides")] if two else []))
    groups = groups.where("_sides > 1").drop("_sides") if two else groups.where("_rows > 1")
    groups = settle(groups.withColumn("_g", F.monotonically_increasing_id()), "groups")
    bands, r = _bands(most, groups.agg(F.max("_rows").alias("m")).first()["m"] or 0, bits)
    masks = [_mask(*band) for band in bands]
    firsts = [F.struct(F.lit(k).cast("long").alias("k"), F.col("bits").bitwiseAND(F.lit(masks[k])).alias("part")) for k in range(len(bands) - r + 1)]
    whole = F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("part"))
    cells = F.when(F.col("_rows") <= compared, F.array(whole)).otherwise(F.array(*firsts))
    more = ["side", "t"] if two else []
    dealt = nodes.join(groups, list(keys)).select("_g", F.explode(cells).alias("_c"), "n", "bits", *more).select("_g", "_c.k", "_c.part", "n", "bits", *more)
    dealt = dealt.repartition("_g", "k", "part").sortWithinPartitions("_g", "k", "part")

    def compare(batches):
        for table in _cells(batches, 3, 1 << 18):
            g, k, part, h = (table.column(c).to_numpy() for c in ("_g", "k", "part", "bits"))
            n = table.column("n").combine_chunks()
            n = n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n
            if two:
                side, t = table.column("side").to_numpy(), table.column("t").to_numpy()

            def out(i, j):
                if two:
                    apart = side[i] != side[j]
                    i, j = i[apart], j[apart]
                    i, j = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
                cols = {"_g": pa.array(g[i]), "i": n.take(pa.array(i)), "j": n.take(pa.array(j))}
                if two:
                    cols |= {"ti": pa.array(t[i]), "tj": pa.array(t[j])}
                return pa.RecordBatch.from_pydict(cols)

            for first in np.unique(k):
                at = np.flatnonzero(k == first)
                for combo in combinations(range(first + 1, len(bands)), r - 1) if first >= 0 else [()]:
                    sub = h[at] & _or(masks[x] for x in combo)
                    order = at[np.lexsort((sub, part[at], g[at]))] if combo else at
                    hs = h[order]
                    for i, j in _close(hs, *_runs(g[order], part[order], hs & _or(masks[x] for x in combo)), most):
                        if first >= 0:
                            # a pair comes once: by the first bands on which it agrees
                            apart, last = hs[i] ^ hs[j], combo[-1] if combo else first
                            once = sum(((apart & masks[x]) == 0).astype(np.int64) for x in range(last)) == r - 1 if last else np.ones(len(i), bool)
                            i, j = i[once], j[once]
                        if len(i):
                            yield out(order[i], order[j])

    kind = nodes.schema["n"].dataType.simpleString()
    found = dealt.mapInArrow(compare, f"_g long, i {kind}, j {kind}" + (", ti long, tj long" if two else ""))
    return found.join(groups.drop("_rows"), "_g").drop("_g")


def _or(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def hamming_join(a: DataFrame, b: DataFrame, most: int, keys: Sequence[str], bits: int = 64, compared: int = COMPARED) -> DataFrame:
    """(``keys``, ``i``, ``j``, ``ti``, ``tj``) of ``a`` and ``b`` (``keys``, ``n``, ``bits``, ``t``) with equal ``keys`` whose hashes differ in at most ``most`` bits.

    Exact, and each pair comes once. ``t`` is a long of one's own.
    """
    sides = [x.select(*keys, "n", "bits", F.lit(k).alias("side"), "t") for k, x in enumerate((a, b))]
    return _near_hashes(sides[0].unionByName(sides[1]), most, keys, bits, compared)


def hamming_pairs(nodes: DataFrame, most: int, *keys: str, bits: int = 64, compared: int = COMPARED) -> DataFrame:
    """(``keys``, ``i``, ``j``) with ``i < j`` for nodes (``keys``, ``n``, ``bits``) at most ``most`` bits apart.

    Exact, and each pair comes once. Nodes should have distinct hashes, else copies meet in pairs.
    """
    if not keys:
        return hamming_pairs(nodes.withColumn("_all", F.lit(0)), most, "_all", bits=bits, compared=compared).drop("_all")
    found = _near_hashes(nodes.select(*keys, "n", "bits"), most, keys, bits, compared)
    return found.where("i <> j").select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def cosine_pairs(nodes: DataFrame, threshold: float, *keys: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``keys``, ``i``, ``j``, ``cosine``) with ``i < j`` for nodes (``keys``, ``n``, ``embedding``) of that cosine or more.

    ``n`` numbers a group's nodes, at best evenly. A group of more than ``block_rows`` nodes is cut
    into blocks, ``BLOCKS`` of them until these reach ``BLOCK_MOST`` nodes, and each pair of blocks
    is compared in a task, tile by tile, in double; so a node goes through the shuffle ``BLOCKS``
    times at most up to BLOCKS * BLOCK_MOST nodes, and only similar pairs leave the task. All
    embeddings of a group must have the same size. Vectors of no length resemble nothing.
    """
    if not keys:
        one = nodes.select("n", "embedding").withColumn("_all", F.lit(0))
        return cosine_pairs(one, threshold, "_all", block_rows=block_rows).drop("_all")
    groups = nodes.groupBy(*keys).agg(F.max("n").alias("_last"), F.count("*").alias("_rows")).where("_rows > 1")
    blocks = F.greatest(F.least(F.ceil(F.col("_rows") / block_rows), F.lit(BLOCKS)), F.ceil(F.col("_rows") / BLOCK_MOST))
    groups = settle(groups.select(*keys, "_last", blocks.alias("_blocks"), F.monotonically_increasing_id().alias("_g")), "groups")
    b = F.floor(F.col("n") * F.col("_blocks") / (F.col("_last") + 1)).cast("long").alias("_b")
    sized = nodes.join(groups, list(keys)).select("_g", "n", "embedding", "_blocks", b)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("_b")).alias("lo"), F.greatest(o, F.col("_b")).alias("hi")))
    dealt = sized.select("_g", "n", "embedding", "_b", F.explode(meets).alias("_p")).select("_g", "_p.lo", "_p.hi", "n", "_b", "embedding")
    dealt = dealt.repartition("_g", "lo", "hi").sortWithinPartitions("_g", "lo", "hi", "_b", "n")

    def compare(batches):
        for table in _cells(batches, 3, 1 << 14):
            g, lo, hi, n, block = (table.column(c).to_numpy() for c in ("_g", "lo", "hi", "n", "_b"))
            rows = table.column("embedding").combine_chunks()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            begin, end = _runs(g, lo, hi)
            least, largest = np.minimum.reduceat(sizes, begin), np.maximum.reduceat(sizes, begin)
            if (least != largest).any():
                at = int(np.flatnonzero(least != largest)[0])
                raise ValueError(f"embeddings of different sizes in one group: {sorted({int(x) for x in sizes[begin[at]:end[at]]})}")
            for size in np.unique(least):
                runs = np.flatnonzero(least == size)
                at = np.flatnonzero(sizes == size)
                x = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                x /= np.where(length > 0, length, np.inf)[:, None]
                s = np.searchsorted(at, begin[runs])
                for i, j, cos in _alike(x, s, s + (end - begin)[runs], block[at], lo[begin[runs]], hi[begin[runs]], threshold):
                    ni, nj = n[at[i]], n[at[j]]
                    yield pa.RecordBatch.from_pydict({"_g": g[at[i]], "i": np.minimum(ni, nj), "j": np.maximum(ni, nj), "cosine": cos})

    found = dealt.mapInArrow(compare, "_g long, i long, j long, cosine double")
    return found.join(groups.drop("_last", "_blocks"), "_g").select(*keys, "i", "j", "cosine")


def _alike(x: np.ndarray, begin: np.ndarray, end: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float):
    """(positions, positions, cosine) of the pairs of each run's blocks with that cosine or more; rows are sorted by block."""
    size, near = end - begin, _NEAR + x.shape[1] * 1.2e-7

    def kept(i, j):
        for k in range(0, len(i), 1 << 15):  # in a dense group every pair of a tile may be one
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            cos = np.einsum("ij,ij->i", x[a], x[b])
            good = cos >= threshold
            yield a[good], b[good], cos[good]

    short = np.flatnonzero((size > 1) & (size <= 32) & (lo == hi))
    stop = np.repeat(end[short], size[short])
    at = stop - (np.arange(len(stop)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])) - 1
    d = 1
    while len(at):
        open_ = at + d < stop
        at, stop = at[open_], stop[open_]
        if len(at):
            yield from kept(at, at + d)
        d += 1
    for r in np.flatnonzero((size > 32) | (lo != hi)):
        s, e = int(begin[r]), int(end[r])
        m = s + int(np.searchsorted(block[s:e], hi[r])) if lo[r] != hi[r] else e
        y = x[s:e].astype(np.float32)
        for p in range(s, m, 512):
            q = min(m, p + 512)
            for u in range(m if m < e else p, e, 4096):
                v = min(e, u + 4096)
                i, j = np.nonzero(y[p - s : q - s] @ y[u - s : v - s].T >= threshold - near)
                i, j = i + p, j + u
                yield from kept(*((i, j) if m < e else (i[i < j], j[i < j])))


def leaders(edges: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, ``n``, ``leader``) of every end of ``edges`` (``keys``, ``i``, ``j``), ``i < j``."""
    on = list(keys)
    edges = settle(edges.select(*on, "i", "j"), "edges")
    open_edges, found = edges, []
    ends = edges.select(*on, F.explode(F.array("i", "j")).alias("n")).distinct()
    undecided = settle(ends, "undecided")
    while undecided.limit(1).count():
        waits = open_edges.select(*on, F.col("j").alias("n")).distinct()
        lead = settle(undecided.join(unsent(waits), [*on, "n"], "left_anti"), "lead")
        found.append(lead)
        covered = open_edges.join(unsent(lead.select(*on, F.col("n").alias("i"))), [*on, "i"], "left_semi").select(*on, F.col("j").alias("n")).distinct()
        decided = lead.unionByName(covered)
        undecided = settle(undecided.join(unsent(decided), [*on, "n"], "left_anti"), "undecided")
        left_i, left_j = (unsent(undecided.select(*on, F.col("n").alias(c))) for c in ("i", "j"))
        open_edges = settle(open_edges.join(left_i, [*on, "i"], "left_semi").join(left_j, [*on, "j"], "left_semi"), "open")
    every = reduce(DataFrame.unionByName, found) if found else ends
    members = edges.join(unsent(every.select(*on, F.col("n").alias("i"))), [*on, "i"], "left_semi")
    first = members.groupBy(*on, F.col("j").alias("n")).agg(F.min("i").alias("leader"))
    own = every.select(*on, "n", F.col("n").alias("leader"))
    return own.unionByName(first.join(unsent(every), [*on, "n"], "left_anti"))
