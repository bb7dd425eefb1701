"""Filling containers of fixed capacity with texts, by lexical retrieval.

Documents are dealt to shards by content: a learned balanced partitioning of their BM25 weights
(projected to a few numbers) puts documents of like words together, so that a seed's neighbours
are mostly in its own shard. In each shard an inverted index answers BM25 queries (all terms of
the seed, statistics over all documents): the largest unused document seeds a container, its
unused neighbours fill it greedily in order of similarity, and what room is left goes to the
largest unused document that fits. Containers that stay emptier than ``FULL`` go up a tree of
wider shards and are packed again, so that only the last few stay partly empty.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle
from photosluice.llm.learned_partitions import fit_partitions
from photosluice.llm.neighbours import _paths
from photosluice.llm.tokens import TOKENIZER, token_bags
from photosluice.llm.vectors import DIM, unit

DOCS_PER_SHARD = 4000
FULL = 0.98
WIDEST = 4  # how many times the documents of a shard a task may hold when open containers are packed again
FIRST = 256  # neighbours put in order at once
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def _signs(size: int, dim: int = DIM) -> np.ndarray:
    """Random signs that project term weights to ``dim`` numbers."""
    return np.random.default_rng(29).choice(np.array([-1, 1], np.int8), (size, dim))


def bm25_weights(idf: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray, mean_size: float) -> np.ndarray:
    norm = K1 * (1 - B + B * size / max(mean_size, 1e-9))
    return idf[term] * tf * (K1 + 1) / (tf + norm)


class ShardIndex:
    """BM25 over the items of one shard; weights are precomputed per posting."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, mean_size: float):
        n = len(terms)
        size = np.array([t.sum() for t in tfs], np.float64)
        count = np.array([len(t) for t in terms], np.int64)
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(tfs).astype(np.float64) if n else np.zeros(0)
        doc = np.repeat(np.arange(n), count)
        weight = bm25_weights(idf, term, tf, size[doc], mean_size)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.terms, self.n = terms, n

    def neighbours(self, i: int):
        """Items that share a term with item ``i``, most similar first, in arrays."""
        ranges = [(self.begin[t], self.begin[t + 1]) for t in self.terms[i]]
        if not ranges:
            return
        docs = np.concatenate([self.doc[s:e] for s, e in ranges])
        score = np.bincount(docs, np.concatenate([self.weight[s:e] for s, e in ranges]), self.n)
        found = np.flatnonzero(score)
        least = np.partition(score[found], len(found) - FIRST)[len(found) - FIRST] if len(found) > 2 * FIRST else 0
        for some in (found[score[found] >= least], found[score[found] < least]):
            yield some[np.lexsort((some, -score[some]))]


def fill(sizes: list[int], capacity: int, neighbours) -> list[list[int]]:
    """Containers of item positions: each seeded by the largest unused item, filled by its neighbours."""
    n = len(sizes)
    free = sorted((sizes[i], -i) for i in range(n))
    used, out, size = np.zeros(n, bool), [], np.asarray(sizes, np.int64)

    def take(i: int) -> None:
        used[i] = True
        key = (sizes[i], -i)
        del free[bisect_right(free, key) - 1]

    while free:
        seed = -free[-1][1]
        room = capacity - sizes[seed]
        take(seed)
        box = [seed]
        for some in neighbours(seed) if room > 0 and free and free[0][0] <= room else ():
            for c in some[~used[some] & (size[some] <= room)].tolist():
                if sizes[c] <= room:
                    take(c), box.append(c)
                    room -= sizes[c]
                    if not free or free[0][0] > room:
                        break
            if not free or free[0][0] > room:
                break
        while free and room >= free[0][0]:
            at = bisect_right(free, (room, 1)) - 1
            i = -free[at][1]
            take(i), box.append(i)
            room -= sizes[i]
        out.append(box)
    return out


def content_shards(bags: DataFrame, idf: np.ndarray, mean_size: float, docs_per_shard: int) -> DataFrame:
    """``bags`` with ``shard``: documents of like words together, about ``docs_per_shard`` in each.

    A partition that the classifier overfills is divided by chance.
    """

    def rows_of(b):
        signs = _signs(len(idf))
        terms, tfs = (_lists(b.column(b.schema.get_field_index(c))) for c in ("terms", "tf"))
        size = b.column(b.schema.get_field_index("tokens")).to_numpy(zero_copy_only=False)
        rows = [bm25_weights(idf, t, f, s, mean_size) @ signs[t] for t, f, s in zip(terms, tfs, size)]
        return np.asarray(rows, np.float32).reshape(-1, DIM)

    def project(batches):
        for b in batches:
            rows = rows_of(b)
            cuts = pa.array((np.arange(len(rows) + 1) * DIM).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(rows.ravel()))], names=["vec"])

    # cheap enough to be done again where it is needed, instead of being written
    vectors = bags.mapInArrow(project, "vec array<float>").withColumn("id", F.lit(0))
    model = fit_partitions(vectors, "id", "vec", docs_per_shard, 1.0, least=0.98)

    def home(batches):
        for b in batches:
            rows = rows_of(b)
            good = np.flatnonzero((rows != 0).any(axis=1))
            part = np.full(len(rows), -1, np.int32)
            if len(good):
                routes = model.route(unit(rows[good]).astype(np.float32), good)
                part[good], _ = _paths(len(good), *routes, None, model.partitions)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bags.schema)
    placed = bags.mapInArrow(home, f"{fields}, part int")
    # at most one row a partition of the model
    counts = placed.groupBy("part").agg(F.ceil(F.count("*") / (1.5 * docs_per_shard)).alias("cuts"))
    chance = F.pmod(F.xxhash64("doc_id"), F.col("cuts"))
    return placed.join(F.broadcast(counts), "part").withColumn("shard", F.col("part") * F.lit(1 << 20) + chance).drop("part", "cuts")


def _idf(bags: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by token id over all documents; their number is bounded by the vocabulary."""
    rows = bags.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    total = bags.agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
    t, df = rows.column("t").to_numpy(), rows.column("count").to_numpy()
    out = np.zeros(int(t.max()) + 1 if len(t) else 1)
    out[t] = np.log1p((total["n"] - df + 0.5) / (df + 0.5))
    return out, float(total["mean"] or 0)


def pack(
    docs: DataFrame,
    sizes: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    docs_per_shard: int = DOCS_PER_SHARD,
    full: float = FULL,
) -> DataFrame:
    """(``pack_id``, ``container``, ``place``, ``doc_id``, ``piece``, ``token_start``, ``tokens``) for every pack.

    ``sizes`` has (``pack_id``, ``capacity_tokens``). A document stays whole unless it alone
    exceeds the capacity: then it is cut into pieces of exactly the capacity and a rest, all
    numbered. Containers that packing again no longer fills stay as they are. Every document occurs once in every pack, whole repeats of a row once; documents
    with null or empty text take no room and are left out; rows without id too; packs of no
    capacity give no rows. ``container`` is unique within its pack. Empty tables give no rows.
    """
    clean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    bags = settle(token_bags(clean, "doc_id", "text", tokenizer).where("tokens > 0").dropDuplicates(["doc_id"]), "bags")
    idf, mean = _idf(bags)
    packs = _settings(sizes)
    kind = bags.schema["doc_id"].dataType.simpleString()
    schema = f"pack_id string, container string, place int, doc_id {kind}, piece long, token_start long, tokens long, kept boolean"
    total_docs = bags.count()
    one_shard = total_docs <= docs_per_shard
    dealt = bags.withColumn("shard", F.lit(0).cast("long")) if one_shard else content_shards(bags, idf, mean, docs_per_shard)
    shards = 1 if one_shard else -(-total_docs // docs_per_shard)

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        total = table.column("tokens").to_numpy()
        terms, tfs = (_lists(table.column(c)) for c in ("terms", "tf"))
        index = ShardIndex(terms, tfs, idf, mean)
        out = []
        for pack_id, capacity in packs:
            # full pieces are containers of their own; each document leaves at most one open piece
            whole = total // capacity
            item = np.repeat(np.arange(len(total)), whole)
            nth = np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)
            out.append(_rows(table, pack_id, item, nth, nth * capacity, np.full(len(item), capacity), [f"f{table['shard'][0]}-{i}" for i in range(len(item))], np.zeros(len(item)), np.ones(len(item), bool)))
            rest = total - whole * capacity
            at = np.flatnonzero(rest)
            out.append(_boxes(table, index, at, whole[at], whole[at] * capacity, rest[at], pack_id, capacity, 0, full, one_shard))
        return pa.concat_tables(out) if out else _rows(table, "", *[np.zeros(0, np.int64)] * 4, [], np.zeros(0), np.zeros(0, bool))

    # a shard's work is far heavier than its bytes: a fixed number of tasks keeps them apart
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.sparkSession.sparkContext.defaultParallelism))
    dealt = dealt.repartition(tasks, "shard")
    packed = settle(dealt.groupBy("shard").applyInArrow(first, schema), "packed")
    parts, level = [packed.where("kept").drop("kept")], 0
    capacity_of = dict(packs)
    while shards > 1:
        most = packed.where("not kept").groupBy("pack_id").count().agg(F.max("count").alias("m")).first()["m"]
        if not most:
            break
        fewer, level = min(-(-most // docs_per_shard), shards - 1), level + 1
        if most > WIDEST * docs_per_shard * fewer:
            # packing them again no longer helps: they stay as they are
            parts.append(packed.where("not kept").drop("kept"))
            break
        shards = fewer if level == 1 or 2 * fewer <= shards else max(1, shards // 2)
        rest = packed.where("not kept").select("pack_id", "doc_id", "piece", "token_start", F.col("tokens").alias("size")).join(bags, "doc_id")
        keyed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(shards))).repartition(tasks, "pack_id", "shard")
        packed = settle(keyed.groupBy("pack_id", "shard").applyInArrow(_again(idf, mean, capacity_of, level, full, shards == 1), schema), "packed")
        parts.append(packed.where("kept").drop("kept"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _again(idf, mean, capacity_of, level, full, last):
    """Function that packs the open pieces of one pack's wider shard, for ``applyInArrow``."""

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        terms, tfs = (_lists(table.column(c)) for c in ("terms", "tf"))
        index, pack_id = ShardIndex(terms, tfs, idf, mean), table["pack_id"][0].as_py()
        piece, start, size = (table.column(c).to_numpy() for c in ("piece", "token_start", "size"))
        return _boxes(table, index, np.arange(len(size)), piece, start, size, pack_id, capacity_of[pack_id], level, full, last)

    return again


def _settings(sizes: DataFrame, most: int = 10_000) -> list[tuple[str, int]]:
    """Packs and capacities, a table of settings that is never long."""
    rows = sizes.where("capacity_tokens > 0 and pack_id is not null").select("pack_id", "capacity_tokens").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pack sizes")
    return sorted((r["pack_id"], int(r["capacity_tokens"])) for r in rows)


def _boxes(table, index, item, piece, start, size, pack_id, capacity, level, full, last) -> pa.Table:
    """Fill containers with open pieces, piece ``i`` being a part of document ``item[i]`` of ``table``."""
    sizes = size.tolist()
    back = np.full(index.n, -1, np.int64)
    back[item] = np.arange(len(item))

    def near(i: int):
        for some in index.neighbours(int(item[i])):
            found = back[some]
            yield found[found >= 0]

    boxes = fill(sizes, capacity, near)
    name = table["shard"][0].as_py() if len(table) else 0
    at = np.array([j for b in boxes for j in b], np.int64)
    of = np.repeat(np.arange(len(boxes)), [len(b) for b in boxes]) if boxes else np.zeros(0, np.int64)
    place = np.array([k for b in boxes for k in range(len(b))], np.int64)
    keep = np.array([last or sum(sizes[j] for j in b) >= full * capacity for b in boxes], bool)
    return _rows(table, pack_id, item[at], piece[at], start[at], size[at], [f"{level}-{name}-{i}" for i in of.tolist()], place, keep[of] if len(of) else np.zeros(0, bool))


def _rows(table, pack_id, item, piece, start, size, container, place, kept) -> pa.Table:
    return pa.table(
        {
            "pack_id": pa.array([pack_id] * len(item), pa.string()),
            "container": pa.array(container, pa.string()),
            "place": pa.array(place.astype(np.int32)),
            "doc_id": table.column("doc_id").take(pa.array(item, pa.int64())),
            "piece": pa.array(np.asarray(piece, np.int64)),
            "token_start": pa.array(np.asarray(start, np.int64)),
            "tokens": pa.array(np.asarray(size, np.int64)),
            "kept": pa.array(kept),
        }
    )


def _lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values, cuts = flat.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]
    return [values[s:e] for s, e in zip(cuts, cuts[1:])]


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(``pack_id``, ``containers``, ``items``, ``tokens``, ``filled``): what part of the capacity is used."""
    boxes = packed.groupBy("pack_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    by = boxes.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    known = sizes.select("pack_id", "capacity_tokens").distinct()
    return by.join(known, "pack_id").select("pack_id", "containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def pack_faults(packed: DataFrame, docs: DataFrame, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``pack_id``, ``documents``, ``lost``, ``overfull``, ``repeated``, ``split``) of every pack: what must be nothing but documents.

    Documents without text are not counted; ``split`` are those in pieces though they fit a container.
    """
    wanted = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("doc_id")).distinct()
    packs = sizes.where("capacity_tokens > 0 and pack_id is not null").select("pack_id", "capacity_tokens").distinct()
    of = packed.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("distinct"))
    of = of.join(packs, "pack_id").groupBy("pack_id").agg(
        F.count("*").alias("documents"),
        F.sum((F.col("pieces") > F.col("distinct")).cast("long")).alias("repeated"),
        F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).cast("long")).alias("split"),
    )
    boxes = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("tokens")).join(packs, "pack_id")
    over = boxes.groupBy("pack_id").agg(F.sum((F.col("tokens") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    gone = packs.select("pack_id").join(wanted.agg(F.count("*").alias("wanted")))
    found = gone.join(of, "pack_id", "left").join(over, "pack_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("pack_id", zero("documents"), (F.col("wanted") - F.coalesce("documents", F.lit(0))).alias("lost"), zero("overfull"), zero("repeated"), zero("split"))
