"""Control flow between stages: forks, cascades and merged statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle
from photosluice.operators.frames import union_all

Branch = Callable[[DataFrame], DataFrame]


def fork(df: DataFrame, branches: Mapping[str, Branch], shared: bool = True) -> DataFrame:
    """Run every branch on the same records; results are tagged with the branch's name and stacked.

    The input is written once, so that branches don't compute it again.
    """
    if not branches:
        raise ValueError("a fork needs branches")
    start = settle(df, "fork") if shared and len(branches) > 1 else df
    return union_all([run(start).withColumn("branch", F.lit(name)) for name, run in branches.items()])


def fork_by_selection(df: DataFrame, branches: Mapping[str, Branch]) -> DataFrame:
    """Run the branches one after another, each on the records that none before it chose (by id)."""
    if not branches:
        raise ValueError("a fork needs branches")
    left, out = settle(df, "cascade"), []
    for i, (name, run) in enumerate(branches.items()):
        chosen = settle(run(left).withColumn("branch", F.lit(name)), "chosen")
        out.append(chosen)
        if i + 1 < len(branches):
            left = settle(left.join(chosen.select("asset_id").distinct(), "asset_id", "left_anti"), "cascade")
    return union_all(out)


def merge_stats(stats: DataFrame) -> DataFrame:
    """(``parent``, ``key``, ``kind``, ``value``) from the children's (``parent``, ``child``, ``key``, ``kind``, ``value``).

    Values are text of a kind: numbers are added, booleans hold if any does, lists (JSON arrays)
    are joined in order of the children, of anything else the first counts.
    """
    w = F.struct("child", "value")
    lists = F.transform(F.array_sort(F.collect_list(w)), lambda x: F.from_json(x["value"], "array<string>"))
    by = stats.groupBy("parent", "key", "kind").agg(
        F.sum(F.expr("try_cast(value as double)")).alias("total"),
        F.max(F.lower("value") == "true").alias("any"),
        F.to_json(F.flatten(lists)).alias("joined"),
        F.min(w)["value"].alias("first"),
    )
    value = (
        F.when(F.col("kind") == "number", F.when(F.col("total") == F.floor("total"), F.col("total").cast("bigint").cast("string")).otherwise(F.col("total").cast("string")))
        .when(F.col("kind") == "boolean", F.col("any").cast("string"))
        .when(F.col("kind") == "list", F.col("joined"))
        .otherwise(F.col("first"))
    )
    return by.select("parent", "key", "kind", value.alias("value"))
