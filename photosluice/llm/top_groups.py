"""The N highest-scoring items of every group, by statistics-guided skipping.

The rows are laid out once in files clustered by group, with small row groups. Within a file the
best items of all groups come first: rows are ordered by how many better ones of their group the
file holds (``ahead``, rounded down to a power of two less one), then by group, score and id. A
query reads only footers first. The row groups' statistics give, for each large group, a score
that its N-th item surely reaches, and for all others the number of better items that every group
in a row group has at least. Each task reads the row groups of its files in descending maximum
score and skips those in which every contained group's present N-th item is better than all that
the row group can hold. What is left, at most N items a group and task, is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photosluice.core.storage import new_path

ROWS_PER_GROUP = 20_000


def cluster_by_group(items: DataFrame, path: str, rows_per_group: int = ROWS_PER_GROUP) -> None:
    """Write (``grp``, ``score``, ``id``, ``ahead``) clustered by group, in each file the best of all groups first.

    Ranges are cut by group, score and id together, so a group of any size spreads over as many
    files as it fills.
    """
    order = [F.asc("grp"), F.desc("score"), F.asc("id")]

    def with_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = pc.dictionary_encode(b.column(0)).indices.to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            size = np.diff(np.r_[begin, len(codes)])
            rank = np.arange(1, len(codes) + 1) - np.repeat(begin, size)
            if b.column(0)[0].as_py() == last:
                rank[: size[0]] += held
            last, held = b.column(0)[-1].as_py(), int(rank[-1])
            ahead = (1 << np.floor(np.log2(rank)).astype(np.int64)) - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ahead)], names=["grp", "score", "id", "ahead"])

    (
        items.select("grp", "score", "id")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(with_ahead, "grp string, score double, id string, ahead long")
        .sortWithinPartitions("ahead", *order)
        .write.option("parquet.block.row.count.limit", rows_per_group)
        .option("parquet.page.row.count.limit", rows_per_group)
        .parquet(path)
    )


def _local(path: str) -> str:
    return path[len("file://") :] if path.startswith("file://") else path[len("file:") :] if path.startswith("file:") else path


def _open(path: str) -> pq.ParquetFile:
    """A parquet file on any file system that the executors share."""
    if path.startswith(("file:", "/")):
        return pq.ParquetFile(_local(path))
    if path.startswith("dbfs:/"):
        return pq.ParquetFile("/dbfs/" + path[len("dbfs:") :].lstrip("/"))
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    system, inner = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    return pq.ParquetFile(system.open_input_file(inner))


def row_group_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``rg``, ``n``, ``g_min``, ``g_max``, ``s_min``, ``s_max``, ``ahead``) of every row group, from the footers."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                meta = _open(name).metadata
                for i in range(meta.num_row_groups):
                    g = meta.row_group(i)
                    by = {g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)}
                    grp, s = by["grp"], by["score"]
                    known = grp is not None and grp.has_min_max and s is not None and s.has_min_max
                    ahead = by.get("ahead")
                    rows.append(
                        (name, i, g.num_rows, grp.min if known else None, grp.max if known else None, s.min if known else None, s.max if known else None, ahead.min if ahead is not None and ahead.has_min_max else 0)
                    )
            if rows:
                types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "rg", "n", "g_min", "g_max", "s_min", "s_max", "ahead"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(footers, "file string, rg int, n long, g_min string, g_max string, s_min double, s_max double, ahead long")


def with_floor(statistics: DataFrame, n: int) -> DataFrame:
    """Statistics with ``floor``: a score that the N-th item of the row group's only group surely reaches.

    A row group that holds a single group and at least ``n`` rows puts that group's N-th score at
    its own minimum or above; the best such minimum of a group bounds all its other row groups.
    Row groups of several groups have none.
    """
    alone = statistics.where((F.col("g_min") == F.col("g_max")) & (F.col("n") >= n))
    floor = alone.groupBy(F.col("g_min").alias("only")).agg(F.max("s_min").alias("floor"))
    single = F.when(F.col("g_min") == F.col("g_max"), F.col("g_min"))
    return statistics.withColumn("only", single).join(floor, "only", "left").drop("only")


def _scan(n: int):
    """Read a file's row groups best first; yield its N best of each group."""

    def read(table: pa.Table) -> pa.Table:
        name = table.column("file")[0].as_py()
        rows = sorted(table.select(["rg", "g_min", "g_max", "s_max", "floor", "ahead"]).to_pylist(), key=lambda r: (-(r["s_max"] if r["s_max"] is not None else float("inf")), r["rg"]))
        best: dict[str, list] = {}
        file = _open(name)
        for r in rows:
            top = r["s_max"]
            if r["ahead"] >= n:
                continue
            if top is not None:
                if r["floor"] is not None and top < r["floor"]:
                    continue
                only = r["g_min"] if r["g_min"] == r["g_max"] else None
                if only is not None and len(held := best.get(only, [])) >= n and top < held[n - 1][0] * -1:
                    continue
            part = file.read_row_group(r["rg"], columns=["grp", "score", "id"])
            for g, s, i in _leaders(part, n):
                held = best.setdefault(g, [])
                held.append((-s, i))
                held.sort()
                del held[n:]
        out = [(g, -s, i) for g, held in best.items() for s, i in held]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"grp": pa.array(cols[0], pa.string()), "score": pa.array(cols[1], pa.float64()), "id": pa.array(cols[2], pa.string())})

    return read


def _leaders(part: pa.Table, n: int):
    """The first ``n`` items of each group of a row group, whose rows come by group and rank."""
    if not len(part):
        return
    codes = pc.dictionary_encode(part.column("grp").combine_chunks()).indices.to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    rank = np.arange(len(codes)) - np.repeat(begin, np.diff(np.r_[begin, len(codes)]))
    few = part.take(pa.array(np.flatnonzero(rank < n)))
    yield from zip(few.column("grp").to_pylist(), few.column("score").to_pylist(), few.column("id").to_pylist())


def skipped_row_groups(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(``reason``, ``row_groups``, ``rows``) of a clustered table: what statistics alone let the ``n`` best do without."""
    of = with_floor(row_group_statistics(spark, path), n)
    reason = F.when(F.col("ahead") >= n, "better items in the file").when(F.col("s_max") < F.col("floor"), "below the group's bound").otherwise("read")
    return of.groupBy(reason.alias("reason")).agg(F.count("*").alias("row_groups"), F.sum("n").alias("rows"))


def top_of_clustered(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(``grp``, ``id``, ``score``, ``place``): the ``n`` best items of each group of a clustered table."""
    tasks = with_floor(row_group_statistics(spark, path), n)
    partial = tasks.groupBy("file").applyInArrow(_scan(n), "grp string, score double, id string")
    w = Window.partitionBy("grp").orderBy(F.desc("score"), F.asc("id"))
    return partial.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("grp", "id", "score", "place")


def top_items(
    items: DataFrame, group_col: str | Column, id_col: str | Column, score_col: str | Column, n: int, rows_per_group: int = ROWS_PER_GROUP, layout: str | None = None
) -> DataFrame:
    """(``grp``, ``id``, ``score``, ``place``): the ``n`` highest-scoring items of every group.

    Null and NaN scores count as 0, others are limited to 0..1; equal scores are decided by the
    smaller id; a repeated (group, id) counts once, with its best score; rows without group or id
    are left out. An empty table gives no rows; other columns are ignored. The clustered table is
    kept at ``layout``, if given, for later calls of :func:`top_of_clustered` with any ``n``.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    s = as_col(score_col).cast("double")
    clean = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    rows = items.select(as_col(group_col).alias("grp"), clean.alias("score"), as_col(id_col).alias("id")).where("grp is not null and id is not null")
    rows = rows.groupBy("grp", "id").agg(F.max("score").alias("score"))
    path = layout or new_path(items.sparkSession, "clustered")
    cluster_by_group(rows, path, rows_per_group)
    return top_of_clustered(items.sparkSession, path, n)


def top_of_contexts(contexts: DataFrame, assets: DataFrame, n: int = 3, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`top_items` of every context of assets; an asset that is not known scores 0."""
    s = F.col("score")
    clean = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    known = assets.select(F.col("asset_id").alias("id"), clean.alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    rows = contexts.select(F.col("partition_id").alias("grp"), F.col("asset_id").alias("id")).join(known, "id", "left")
    return top_items(rows, "grp", "id", "score", n, rows_per_group)
