"""Filters over the frame: per record, by sets of ids, sampling and limits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photosluice.functions.scalars import unit_score
from photosluice.operators.frames import KEYS, columns_or_null, in_context, in_order, reorder
from photosluice.sources.library import as_day

EMPTY_POOL = ("skip", "fail", "fallback_random")


class EmptyPoolError(RuntimeError):
    """A filter left no candidates where the pipeline demands some."""


def non_images(df: DataFrame) -> DataFrame:
    """Keep records whose MIME type begins with ``image/``, in any case; unknown types go."""
    return df.where(F.lower("mime_type").startswith("image/"))


def min_score(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Keep scores of ``threshold`` or more, a missing one being 0; a threshold of 0 keeps all."""
    if threshold <= 0:
        return df
    return df.where(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)) >= threshold)


def screenshots(df: DataFrame) -> DataFrame:
    """Drop screenshots; unknown counts as none."""
    return df.where(~F.coalesce("is_screenshot", F.lit(False)))


def first_n(df: DataFrame, photo_count: int = 500) -> DataFrame:
    """The first records of each context, in list order."""
    return df.withColumn("_r", F.row_number().over(in_order())).where(F.col("_r") <= photo_count).drop("_r")


def sample_key(seed, asset_id: str = "asset_id") -> Column:
    """Sort key of a reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(asset_id)))


def random_sample(df: DataFrame, photo_count: int = 500, seed: int | None = None) -> DataFrame:
    """A uniform sample without replacement of each context, the same for the same seed.

    The sample is drawn by the order of a hash of seed and id. Without a seed, one is drawn.
    """
    if seed is None:
        import secrets

        seed = secrets.randbelow(2**31)
    w = in_context().orderBy(sample_key(seed), F.asc("ord"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= photo_count).drop("_r")


def empty_pool(candidates: DataFrame, pool: DataFrame, photo_count: int, on_empty_pool: str = "skip", rng_seed: int = 0) -> DataFrame:
    """What a filter that found ``candidates`` in ``pool`` passes on.

    Up to ``photo_count`` candidates, sampled if there are more. Without any: nothing (``skip``),
    a sample of the pool (``fallback_random``), or :class:`EmptyPoolError` (``fail``).
    """
    if on_empty_pool not in EMPTY_POOL:
        raise ValueError(f"on_empty_pool must be one of {', '.join(EMPTY_POOL)}")
    sampled = random_sample(candidates, photo_count, rng_seed)
    if on_empty_pool == "skip":
        return sampled
    if on_empty_pool == "fail":
        if candidates.limit(1).count() == 0:
            raise EmptyPoolError("no candidates left")
        return sampled
    empty = pool.join(candidates.select(*KEYS).distinct(), KEYS, "left_anti")
    return sampled.unionByName(random_sample(empty, photo_count, rng_seed))


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Keep the records whose id is in ``ids``."""
    return df.join(ids.select(F.col(id_col).alias("asset_id")), "asset_id", "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str = "asset_id") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias("asset_id")), "asset_id", "left_anti")


def on_this_day(df: DataFrame, run_date: date | str) -> DataFrame:
    """Keep what was captured on the run date's day of any year (UTC)."""
    day = as_day(run_date)
    utc = F.to_utc_timestamp("captured_at", F.current_timezone())
    return df.where((F.month(utc) == day.month) & (F.dayofmonth(utc) == day.day))


def people(df: DataFrame, faces: DataFrame) -> DataFrame:
    """Keep records on which ``faces`` (``asset_id``) knows somebody."""
    return keep_ids(df, faces)


def smart_search(df: DataFrame, hits: DataFrame, max_candidates: int = 500, photo_count: int = 500) -> DataFrame:
    """Keep the first ``max_candidates`` of ``hits`` (``asset_id``, ``rank``), in the order of the hits."""
    first = hits.groupBy("asset_id").agg(F.min("rank").alias("_rank"))
    best = first.orderBy("_rank", "asset_id").limit(max_candidates)
    found = reorder(df.join(best, "asset_id"), "_rank").drop("_rank")
    return first_n(found, photo_count)


def sensitive_signals(
    df: DataFrame,
    blocklist_ids: Sequence[str] = (),
    blocked_tags: Sequence[str] = (),
    negative_hits: DataFrame | None = None,
    vision_threshold: float = 0.7,
    fail_closed: bool = False,
) -> DataFrame:
    """``df`` with ``signals``: why a record is held back, empty if it isn't.

    Signals: ``negative_query`` once for each query among ``negative_hits`` (``asset_id``,
    ``query``) that found it, ``blocklist``, ``tag``, ``vision``, and ``fail_closed`` for records
    whose flags could not be determined.
    """
    df = columns_or_null(df, tags="array<string>", vision_flags="map<string,double>", vision_error="string")
    hits = F.lit(0)
    if negative_hits is not None:
        found = negative_hits.select("asset_id", "query").distinct().groupBy("asset_id").agg(F.count("*").cast("int").alias("_hits"))
        df = df.join(found, "asset_id", "left")
        hits = F.coalesce("_hits", F.lit(0))
    listed = F.col("asset_id").isin(*blocklist_ids) if blocklist_ids else F.lit(False)
    tagged = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, blocked_tags))), F.lit(False)) if blocked_tags else F.lit(False)
    seen = F.coalesce(F.exists(F.map_values("vision_flags"), lambda v: F.coalesce(v >= vision_threshold, F.lit(False))), F.lit(False))
    blind = F.col("vision_flags").isNull() & F.col("vision_error").isNotNull() if fail_closed else F.lit(False)
    one = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.expr("cast(array() as array<string>)"))
    signals = F.concat(
        F.array_repeat(F.lit("negative_query"), hits), one(listed, "blocklist"), one(tagged, "tag"), one(seen, "vision"), one(blind, "fail_closed")
    )
    return df.withColumn("signals", signals).drop("_hits")


def sensitive(df: DataFrame, enabled: bool = False, **signals) -> DataFrame:
    """Drop records with any sensitive signal; off unless enabled."""
    if not enabled:
        return df
    return sensitive_signals(df, **signals).where(F.size("signals") == 0).drop("signals")


def sensitive_tally(marked: DataFrame) -> DataFrame:
    """(``signal``, ``n``) over records with ``signals``."""
    return marked.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def scored(df: DataFrame) -> DataFrame:
    """``df`` with its score limited to 0..1, missing ones 0."""
    return df.withColumn("score", unit_score("score"))


def latest_rows(df: DataFrame, key: str, *by: Column) -> DataFrame:
    """One row a key, the first by ``by``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_r = 1").drop("_r")
