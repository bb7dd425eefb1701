"""Keyed caches as append-only tables: the last write of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def compact(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The latest row of every key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def read_json_cache(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(``key``, ``value``) from JSON lines; broken lines are skipped, the last line of a key wins."""
    lines = spark.read.schema(f"key string, value {value_schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    numbered = lines.withColumn("seq", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))
    return compact(numbered.where("_bad is null and key is not null").select("key", "value", "seq"), "key", "seq").drop("seq")


def tuple_key(*parts: Column) -> Column:
    """Key of several parts as a JSON array, so that separators inside a part can't collide."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def lookup(rows: DataFrame, cache: DataFrame | None, key: Column, value: str = "value") -> DataFrame:
    """``rows`` with ``_key`` and the cached ``_hit`` (null where there is none)."""
    keyed = rows.withColumn("_key", key)
    if cache is None:
        return keyed.withColumn("_hit", F.lit(None).cast("string"))
    return keyed.join(cache.select(F.col("key").alias("_key"), F.col(value).alias("_hit")), "_key", "left")


def hit_counts(rows: DataFrame) -> DataFrame:
    """(``total_assets``, ``cached``, ``computed``) of looked-up rows."""
    return rows.agg(F.count("*").alias("total_assets"), F.count("_hit").alias("cached"), F.count_if(F.col("_hit").isNull()).alias("computed"))


def latest(history: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """(``key``, ``value``) of the row latest by ``by``; equal ones are decided by the larger value."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), F.desc_nulls_last(value))
    return history.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value)
