"""The frame that flows between stages: one DataFrame for all contexts.

Columns that the stages add to a record's own: ``branch`` (of a fork, '' at first), ``ctx`` (path
of the context: an array of name and number, [] at first) and ``ord`` (order of the record within
its branch, an array compared from left to right; ties are decided by ``asset_id``). Contexts
without records have no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from photosluice.core.storage import settle

KEYS = ["branch", "ctx"]
LAST = 2**63 - 1


def asset_frame(assets: DataFrame, distinct: bool = True) -> DataFrame:
    """Assets as the root context, in order of capture (unknown times last).

    An asset delivered more than once counts once; rows without id are left out.
    """
    rows = assets.where(F.col("asset_id").isNotNull())
    if distinct:
        rows = rows.dropDuplicates(["asset_id"])
    return rows.withColumns(
        {
            "branch": F.lit(""),
            "ctx": F.expr("cast(array() as array<struct<name:string,idx:bigint>>)"),
            "ord": F.array(F.coalesce(F.unix_micros("captured_at"), F.lit(LAST))),
        }
    )


def in_context(*extra: str | Column) -> WindowSpec:
    return Window.partitionBy(*KEYS, *extra)


def in_order(*by: Column) -> WindowSpec:
    """Window over a context's records in list order, or ``by`` and then list order."""
    return in_context().orderBy(*by, F.asc("ord"), F.asc("asset_id"))


def split(df: DataFrame, name: str | Column, group: str | Column, *within: str | Column) -> DataFrame:
    """Make each ``group`` (a number in order of emission, per context) a context of its own.

    ``within`` (whole numbers) orders the records of a group; without it they keep their order.
    """
    label = F.lit(name) if isinstance(name, str) else name
    g = (F.col(group) if isinstance(group, str) else group).cast("bigint")
    above = F.transform("ctx", lambda x: x["idx"])
    own = F.slice("ord", F.size("ctx") + 1, F.greatest(F.size("ord") - F.size("ctx"), F.lit(0)))
    rest = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in within]) if within else own
    return df.withColumns(
        {
            "ord": F.concat(above, F.array(g), rest),
            "ctx": F.concat("ctx", F.array(F.struct(label.cast("string").alias("name"), g.alias("idx")))),
        }
    )


def ranged(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """``df`` written in ranges of ``keys`` and ``order``, with ``_pid`` and ``_mid``.

    Within equal keys, ranges ascend with ``_pid`` and rows with ``_mid``. A context of any size
    spreads over as many ranges as it fills, so that no later step holds it whole.
    """
    by = [*[F.asc(k) for k in keys], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return settle(rows.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "ranged")


def running_sum(rows: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """``rows`` (see :func:`ranged`) with the sum of ``value`` up to and with each row, within its keys."""
    local = Window.partitionBy(*keys, "_pid").orderBy("_mid")
    rows = rows.withColumn("_v", value)
    totals = rows.groupBy(*keys, "_pid").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_ahead", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    summed = rows.withColumn("_local", F.sum("_v").over(local))
    return summed.join(offsets, [*keys, "_pid"]).withColumn(out, F.col("_ahead") + F.col("_local")).drop("_v", "_ahead", "_local")


def previous(rows: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """``rows`` (see :func:`ranged`) with the ``value`` (a struct) of the row before, within its keys."""
    local = Window.partitionBy(*keys, "_pid").orderBy("_mid")
    rows = rows.withColumn("_v", value)
    last = rows.groupBy(*keys, "_pid").agg(F.max_by("_v", "_mid").alias("_l"))
    carried = last.withColumn("_carry", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_pid"))).drop("_l")
    found = rows.withColumn("_p", F.lag("_v").over(local)).join(carried, [*keys, "_pid"])
    return found.withColumn(out, F.coalesce("_p", "_carry")).drop("_v", "_p", "_carry")


def ranked(df: DataFrame, keys: Sequence[str], out: str, *order: Column) -> DataFrame:
    """``df`` with ``out``: place of each row within its keys, from 0. The result is written out."""
    return running_sum(ranged(df, keys, *order), keys, F.lit(1), out).withColumn(out, F.col(out) - 1).drop("_pid", "_mid")


def merge(df: DataFrame) -> DataFrame:
    """Join sibling contexts into their parent; at the root all branches become one."""
    deep = F.size("ctx")
    return df.withColumns(
        {
            "branch": F.when(deep <= 1, F.lit("")).otherwise(F.col("branch")),
            "ctx": F.slice("ctx", F.lit(1), F.greatest(deep - 1, F.lit(0))),
        }
    )


def context_id(root: str = "root") -> Column:
    """Text id of a context: the names and numbers of its path, joined by two underscores."""
    steps = F.transform("ctx", lambda x: F.concat_ws("_", x["name"], x["idx"].cast("string")))
    return F.concat_ws("__", F.lit(root), steps)


def reorder(df: DataFrame, *by: str | Column) -> DataFrame:
    """Make the whole numbers ``by`` the list order of each context."""
    above = F.transform("ctx", lambda x: x["idx"])
    return df.withColumn("ord", F.concat(above, F.array(*[(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in by])))


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with each named column, null of the given type where it has none."""
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
