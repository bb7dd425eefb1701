"""The most similar vectors of every vector, by learned partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photosluice.llm.learned_partitions import PartitionModel, fit_partitions
from photosluice.llm.vectors import DIM, pack, unit, unpack, usable_rows, vector_key

ROWS_PER_PARTITION = 6000
MEAN_PROBES = 2.6
ROUTE_ROWS = 50_000  # rows of a routed batch, 13 MB of vectors
_SEP = "\x1f"
_TIE = 2e-6  # float32 products may differ by so much from those in double


def routed(df: DataFrame, id_col: str | Column, vec_col: str, model: PartitionModel, keep_ids: int, dim: int = DIM, marks: int = 0) -> DataFrame:
    """One row for every distinct usable vector and partition that it is stored or sought in.

    Columns: ``part``, ``home`` (stored there), ``h`` (vector key), ``v`` (packed float32) and
    ``ids``, the ``keep_ids`` smallest ids of the vector's copies. Copies within a batch are
    joined before the shuffle, so that a vector shared by a third of all rows stays small.

    With ``marks``, ids are longs, of which at most ``marks`` come packed as ``m``, and each row also
    has ``hp``, its vector's own partition; the one stored there has ``via``, packed: the other
    partitions in which the vector meets others (but for those of its own dense group).
    """
    bounds = None if model.dense is None else model.partitions + np.cumsum(model.blocks * (model.blocks + 1) // 2)

    def route(batches):
        for b in batches:
            at, rows = usable_rows(b.column(1), dim)
            if not len(at):
                continue
            key = b.column(2).to_numpy(zero_copy_only=False)[at]
            uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            names = None
            if keep_ids:
                ids = np.asarray(b.column(0).take(pa.array(at)).to_pylist(), dtype=object)
                names = ids[first]
                twice = np.flatnonzero(np.bincount(inverse) > 1)
                if len(twice):
                    order = np.argsort(inverse, kind="stable")
                    begin = np.searchsorted(inverse[order], twice)
                    end = np.searchsorted(inverse[order], twice, side="right")
                    for u, s, e in zip(twice, begin, end):
                        names[u] = _SEP.join(sorted({x for x in ids[order[s:e]] if x is not None})[:keep_ids])
            rows = rows[first]
            routes = model.route(unit(rows).astype(np.float32), uniq)
            if marks:
                hp, via = _paths(len(uniq), *routes, bounds, model.partitions)
                few = _few_of(inverse, b.column(0).to_numpy(zero_copy_only=False)[at], len(uniq), marks)
            for s in range(0, len(routes[0]), ROUTE_ROWS):
                row, part, home = (r[s : s + ROUTE_ROWS] for r in routes)
                cols = [pa.array(part.astype(np.int32)), pa.array(home), pa.array(uniq[row]), pack(rows[row])]
                fields = ["part", "home", "h", "v"]
                if keep_ids:
                    cols.append(pa.array(names[row], pa.string()))
                    fields.append("ids")
                if marks:
                    stays = pa.array(np.where(home, row, 0), mask=~(home & (part == hp[row])))
                    cols += [pa.array(hp[row]), via.take(stays), few.take(pa.array(row))]
                    fields += ["hp", "via", "m"]
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    schema = "part int, home boolean, h long, v binary" + (", ids string" if keep_ids else "") + (", hp int, via binary, m binary" if marks else "")
    return df.select(id_col, vec_col, vector_key(vec_col).alias("h")).mapInArrow(route, schema)


def _paths(n: int, row: np.ndarray, part: np.ndarray, home: np.ndarray, bounds, plain: int) -> tuple[np.ndarray, pa.Array]:
    """Own partition of each of ``n`` vectors and, packed, the others that it meets others in."""
    hp = np.full(n, np.iinfo(np.int32).max, np.int32)
    np.minimum.at(hp, row[home], part[home].astype(np.int32))  # the diagonal is the first of a block's partitions
    keep = part != hp[row]
    if bounds is not None:
        group = lambda p: np.searchsorted(bounds, p, side="right")
        keep &= (hp[row] < plain) | (group(part) != group(hp[row]))
    return hp, _packed(row[keep], part[keep].astype(np.int32), n)


def _few_of(group: np.ndarray, value: np.ndarray, n: int, most: int) -> pa.Array:
    """The ``most`` smallest distinct values of each of ``n`` groups, packed."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    g, v = g[new], v[new]
    keep = np.arange(len(g)) - np.searchsorted(g, g) < most
    return _packed(g[keep], v[keep], n)


def _packed(group: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """The values of each of ``n`` groups as one binary value, null where there are none."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n + 1))
    some = pa.py_buffer(np.packbits(np.diff(cuts) > 0, bitorder="little"))
    data = np.ascontiguousarray(value[order])
    return pa.Array.from_buffers(pa.binary(), n, [some, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column made by :func:`_packed`, and the row of each."""
    width, at, values, rows = np.dtype(dtype).itemsize, 0, [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        cuts = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4) if len(c) else np.zeros(1, np.int32)
        if cuts[-1] > cuts[0]:
            values.append(np.frombuffer(c.buffers()[2], dtype, (cuts[-1] - cuts[0]) // width, cuts[0]))
            rows.append(at + np.repeat(np.arange(len(c)), np.diff(cuts) // width))
        at += len(c)
    return np.concatenate(values), np.concatenate(rows)


def partition_arrays(table: pa.Table, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, int, list[str] | None]:
    """(keys, float32 rows, number stored here, ids): stored vectors first, every key once a side."""
    key = table.column("h").to_numpy()
    home = table.column("home").to_numpy(zero_copy_only=False)
    order = np.lexsort((key, ~home))
    k, hm = key[order], home[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (hm[1:] != hm[:-1])]
    first = order[new]
    ids = None
    if "ids" in table.column_names:
        names = table.column("ids").to_pylist()
        ids = [names[i] for i in first]
        if len(first) < len(order):
            group = np.cumsum(new) - 1
            for g in np.unique(group[~new]):
                every = {x for i in order[group == g] for x in (names[i] or "").split(_SEP) if x}
                ids[g] = _SEP.join(sorted(every)[: max(len(every), 1)])
    return key[first], unpack(table.column("v"), dim)[first], int(home[first].sum()), ids


def _cut(sims: np.ndarray, mask: np.ndarray, k: int) -> None:
    """In rows of many hits, keep those of the ``k``-th best or better (ties included)."""
    dense = np.flatnonzero(np.count_nonzero(mask, axis=1) > 3 * k)
    if len(dense):
        part = sims[dense]
        kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        mask[dense] &= part >= (kth - _TIE)[:, None]


def partition_hits(x: np.ndarray, stored: int, least: float, k: int, anchor: bool, block: int = 512):
    """Candidate (query, stored or querying) index pairs with cosine of about ``least`` or more.

    ``x`` has the stored unit rows first, then the rows that only query. Every stored row sees all
    others, every querying row all stored ones. With ``anchor`` the smallest index among a row's
    hits is always kept, which ties the members of a dense group together.
    """
    n, qs, cs = len(x), [], []
    block = max(16, min(block, (1 << 24) // max(n, 1)))
    xt = np.ascontiguousarray(x.T)
    for s in range(0, stored, block):
        e = min(stored, s + block)
        sims = x[s:e] @ xt
        sims[np.arange(e - s), np.arange(s, e)] = -2
        mask = sims >= least - _TIE
        if not mask.any():
            continue
        foreign = np.ascontiguousarray(mask[:, stored:].T) if n > stored else None
        lead = mask.argmax(axis=1) if anchor else None
        _cut(sims, mask, k)
        if anchor:
            has = mask.any(axis=1)
            mask[np.flatnonzero(has), lead[has]] = True
        flat = np.flatnonzero(mask)
        qs.append(flat // n + s), cs.append(flat % n)
        if foreign is not None and foreign.any():
            some = np.flatnonzero(foreign.any(axis=1))
            sub = foreign[some]
            lead = sub.argmax(axis=1)
            _cut(np.ascontiguousarray(sims[:, stored + some].T), sub, k)
            if anchor:
                sub[np.arange(len(some)), lead] = True
            i, j = np.nonzero(sub)
            qs.append(some[i] + stored), cs.append(j + s)
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(qs), np.concatenate(cs)


def exact_cosine(u: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Cosines in double of rows ``a`` and ``b`` of the unit rows ``u``."""
    out = np.empty(len(a))
    for s in range(0, len(a), block):
        out[s : s + block] = np.einsum("ij,ij->i", u[a[s : s + block]], u[b[s : s + block]])
    return out


def similar_vectors(
    df: DataFrame,
    id_col: str = "asset_id",
    vec_col: str = "embedding",
    k: int = 5,
    least: float = 0.86,
    rows_per_partition: int = ROWS_PER_PARTITION,
    mean_probes: float = MEAN_PROBES,
    dim: int = DIM,
    model: PartitionModel | None = None,
) -> DataFrame:
    """(``id``, ``neighbour``, ``cosine``, ``place``): the ``k`` most similar others of every row.

    Only pairs with a cosine of at least ``least`` (computed in double) count; order is by cosine
    rounded to 6 decimals, descending, then the smaller id. Rows whose vector is null, of another
    size, all zero or not finite are left out; a row delivered more than once counts once; exact
    copies of a vector are each other's neighbours; an empty table gives no rows. Other columns of
    ``df`` are ignored, whatever their names. A row without an id is left out.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull())
    if model is None:
        model = fit_partitions(source, "id", "vec", rows_per_partition, mean_probes, dim=dim, least=least)

    def search(table: pa.Table) -> pa.Table:
        key, rows, stored, ids = partition_arrays(table, dim)
        u = unit(rows) if len(rows) else rows
        q, c = partition_hits(u.astype(np.float32), stored, least, 2 * k + 2, False)
        cos = exact_cosine(u, q, c)
        good = cos >= least
        q, c, cos = q[good], c[good], np.round(cos[good], 6)
        order = np.lexsort((-cos, q))
        q, c, cos = q[order], c[order], cos[order]
        out_q, out_id, out_cos = [], [], []
        for i in range(stored):
            if _SEP in ids[i]:
                for name in ids[i].split(_SEP)[: k + 1]:
                    out_q.append(key[i]), out_id.append(name), out_cos.append(1.0)
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for s, e in zip(begin, np.r_[begin[1:], len(q)] if len(q) else []):
            found = [(-cos[t], name) for t in range(s, e) for name in ids[c[t]].split(_SEP)]
            found.sort()
            for neg, name in found[: k + 1]:
                out_q.append(key[q[s]]), out_id.append(name), out_cos.append(-neg)
        return pa.table({"q": pa.array(out_q, pa.int64()), "n": pa.array(out_id, pa.string()), "c": pa.array(out_cos, pa.float64())})

    found = routed(source, "id", "vec", model, k + 1, dim).groupBy("part").applyInArrow(search, "q long, n string, c double")
    best = (
        found.groupBy("q")
        .agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("c")).alias("c"), "n"))), 1, k + 1).alias("best"))
    )
    member = source.where(F.size("vec") == dim).select("id", vector_key("vec").alias("q")).distinct()
    own = member.join(best, "q").select(
        "id", F.slice(F.filter("best", lambda x: x["n"] != F.col("id")), 1, k).alias("best")
    )
    return own.select("id", F.posexplode("best").alias("place", "b")).select(
        "id", F.col("b.n").alias("neighbour"), (-F.col("b.c")).alias("cosine"), "place"
    )


def neighbour_pairs(df: DataFrame, **params) -> DataFrame:
    """(``asset_a``, ``asset_b``), each pair once: at least one is among the nearest of the other."""
    found = similar_vectors(df, **params)
    return found.select(
        F.least("id", "neighbour").alias("asset_a"), F.greatest("id", "neighbour").alias("asset_b")
    ).distinct()
