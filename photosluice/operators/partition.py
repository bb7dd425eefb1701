"""Splitting contexts: by gaps in time and place, by similarity of hashes or vectors, evenly.

Every stage turns each context into child contexts in a defined order; records that lack what a
stage needs form groups of their own at the end. A context of which no record has it becomes one
group too, so that each split is undone by exactly one merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photosluice.functions.scalars import EARTH_METRES, bits_of_hash, haversine, most_distance, place
from photosluice.core.storage import settle, unsent
from photosluice.operators.frames import KEYS, LAST, previous, ranged, ranked, running_sum, split
from photosluice.operators.similarity import cosine_pairs, hamming_pairs, leaders


def _bursts(df: DataFrame, breaks) -> DataFrame:
    """``df`` with ``_us`` and ``_g``, the number of its group: timed records in order of time and id,
    a new group where ``breaks(before)`` holds, ``before`` being the record before; untimed ones last."""
    df = df.withColumns({"_us": F.unix_micros("captured_at"), "_lat": place("latitude"), "_lon": place("longitude")})
    rows = ranged(df.where("_us is not null"), KEYS, F.asc("_us"), F.asc("asset_id"), F.asc("ord"))
    rows = previous(rows, KEYS, F.struct("_us", "_lat", "_lon"), "_before")
    new = F.when(F.col("_before").isNull(), 1).otherwise(F.coalesce(breaks(F.col("_before")).cast("int"), F.lit(1)))
    timed = running_sum(rows.withColumn("_new", new), KEYS, F.col("_new"), "_g").withColumn("_g", F.col("_g") - 1)
    timed = timed.drop("_pid", "_mid", "_before", "_new")
    groups = timed.groupBy(*KEYS).agg((F.max("_g") + 1).alias("_g"))
    untimed = df.where("_us is null").join(groups, KEYS, "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    return timed.unionByName(untimed)


def _micros(minutes: float) -> int:
    return round(minutes * 60_000_000)


def by_time(df: DataFrame, time_window_minutes: float = 5.0) -> DataFrame:
    """Bursts: a record more than the window after the one before it begins a new group.

    Gaps are compared in whole microseconds, one as long as the window stays together. Order is
    by time, then id. Records without a time form the last group.
    """
    window = _micros(time_window_minutes)
    grouped = _bursts(df, lambda before: F.col("_us") - before["_us"] > window)
    return split(grouped, "time", "_g", F.coalesce("_us", F.lit(LAST))).drop("_us", "_g", "_lat", "_lon")


def by_time_and_place(df: DataFrame, time_window_minutes: float = 5.0, gps_window_meters: float = 100.0) -> DataFrame:
    """As :func:`by_time`, but a record also begins a new group if it lies farther than the second
    window from the one before it, or if either has no place."""
    window = _micros(time_window_minutes)

    def breaks(before: Column) -> Column:
        near = haversine(before["_lat"], before["_lon"], "_lat", "_lon") <= gps_window_meters
        return (F.col("_us") - before["_us"] > window) | ~F.coalesce(near, F.lit(False))

    grouped = _bursts(df, breaks)
    return split(grouped, "time_gps", "_g", F.coalesce("_us", F.lit(LAST))).drop("_us", "_g", "_lat", "_lon")


def _anchored(radius: float):
    """Numbers of the groups of one burst: a place joins the first group whose first place is near."""

    def assign(burst: pd.DataFrame) -> pd.DataFrame:
        burst = burst.sort_values("first", kind="stable")
        lat, lon = np.radians(burst["lat"].to_numpy(float)), np.radians(burst["lon"].to_numpy(float))
        group = np.zeros(len(burst), np.int64)
        al, ao, n = np.empty(len(burst)), np.empty(len(burst)), 0
        for i in range(len(burst)):
            a = np.sin((al[:n] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(al[:n]) * np.sin((ao[:n] - lon[i]) / 2) ** 2
            near = 2 * EARTH_METRES * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) <= radius
            at = int(near.argmax()) if n and near.any() else n
            if at == n:
                al[n], ao[n] = lat[i], lon[i]
                n += 1
            group[i] = at
        return burst[["branch", "path", "big", "lat", "lon"]].assign(sub=group)

    return assign


def by_time_and_anchor(df: DataFrame, time_window_minutes: float = 5.0, gps_window_meters: float = 100.0) -> DataFrame:
    """Bursts divided by place: in time order, a record joins the first group of its burst whose
    first record is within the radius, else founds one; those without a place follow as one group.
    A burst of which no record has a place stays whole. Untimed records form the last group."""
    window = _micros(time_window_minutes)
    bursts = settle(_bursts(df, lambda before: F.col("_us") - before["_us"] > window).withColumn("path", F.to_json("ctx")), "bursts")
    # the first record of a place stands for all at the very same place
    spots = bursts.where("_us is not null and _lat is not null and _lon is not null")
    spots = spots.groupBy("branch", "path", F.col("_g").alias("big"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).agg(F.min(F.struct("_us", "asset_id", "ord")).alias("f"))
    order = Window.partitionBy("branch", "path", "big").orderBy("f")
    spots = spots.select("branch", "path", "big", "lat", "lon", F.row_number().over(order).alias("first"))
    spots = settle(spots, "spots")
    keys = ["branch", "path", "big"]
    near = lambda c: haversine(f"{c}.lat", f"{c}.lon", "lat", "lon") <= gps_window_meters
    lead = lambda df, c: df.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), "first").alias(c))
    # most bursts have one or two groups, which need no search in order
    one = spots.join(unsent(lead(spots, "p0")), keys).withColumn("n0", near("p0"))
    two = one.join(unsent(lead(one.where("not n0"), "p1")), keys, "left")
    tried = settle(two.select(*keys, "lat", "lon", "first", F.when(F.col("n0"), F.lit(0)).when(near("p1"), F.lit(1)).cast("long").alias("sub")), "tried")
    hard = tried.where("sub is null").select(*keys).distinct()
    searched = tried.join(hard, keys, "left_semi").groupBy(*keys).applyInPandas(
        _anchored(gps_window_meters), "branch string, path string, big long, lat double, lon double, sub long"
    )
    subs = tried.join(hard, keys, "left_anti").drop("first").unionByName(searched)
    subs = settle(subs.select("branch", "path", F.col("big").alias("_g"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "sub"), "places")
    count = subs.groupBy("branch", "path", "_g").agg((F.max("sub") + 1).alias("_n"))
    joined = bursts.join(unsent(subs), ["branch", "path", "_g", "_lat", "_lon"], "left").join(unsent(count), ["branch", "path", "_g"], "left")
    joined = settle(joined.withColumn("_sub", F.coalesce("sub", "_n", F.lit(0))), "placed")
    groups = settle(ranked(joined.select(*KEYS, "_g", "_sub").distinct(), KEYS, "_k", F.asc("_g"), F.asc("_sub")), "groups")
    out = joined.join(unsent(groups), [*KEYS, "_g", "_sub"])
    return split(out, "time_gps_anchor", "_k", F.coalesce("_us", F.lit(LAST))).drop("_us", "_lat", "_lon", "_g", "_sub", "_n", "_k", "sub", "path")


def by_hash(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Groups of similar perceptual hashes, each around its first record in list order.

    Two hashes are similar if at most ``int((1 - threshold) * 64)`` bits differ. Groups are ordered
    by their first record; records without a usable hash follow as single ones.
    """
    # records are written once with all their columns; positions and groups are found without these
    records = settle(df.withColumn("_id", F.monotonically_increasing_id()), "records")
    narrow = records.select(*KEYS, "ord", "asset_id", "_id", bits_of_hash("phash").alias("_bits"))
    placed = ranked(narrow, KEYS, "_at", F.asc("ord"), F.asc("asset_id"))
    marks = settle(placed.select(*KEYS, F.to_json("ctx").alias("path"), "_id", "_at", "_bits"), "marks")
    # equal hashes always share a group: only the first of each takes part
    nodes = marks.where("_bits is not null").groupBy("branch", "path", "_bits").agg(F.min("_at").alias("n"))
    nodes = settle(nodes, "hashes")
    led = leaders(hamming_pairs(nodes.select("branch", "path", "n", F.col("_bits").alias("bits")), most_distance(threshold), "branch", "path"), "branch", "path")
    of = nodes.join(unsent(led), ["branch", "path", "n"], "left").select("branch", "path", "_bits", F.coalesce("leader", "n").alias("_lead"))
    numbers = _numbered(marks.join(unsent(of), ["branch", "path", "_bits"], "left"))
    return split(records.join(unsent(numbers), "_id"), "phash", "_g").drop("_id", "_g")


def _numbered(rows: DataFrame) -> DataFrame:
    """(``_id``, ``_g``), written out: the number of the group of each row's ``_lead``.

    Groups come in order of their leaders, then the rows without one, each alone.
    """
    rows = settle(rows.select(*KEYS, "_id", F.col("_lead").isNull().alias("_late"), F.coalesce("_lead", "_at").alias("_lead")), "led")
    groups = ranked(rows.select(*KEYS, "_late", "_lead").distinct(), KEYS, "_g", F.asc("_late"), F.asc("_lead"))
    return settle(rows.join(unsent(groups), [*KEYS, "_late", "_lead"]).select("_id", "_g"), "numbers")


def _by_vectors(df: DataFrame, name: str, threshold: float) -> DataFrame:
    # records are written once with their vectors; positions, keys and groups are found without these
    records = settle(df.withColumn("_id", F.monotonically_increasing_id()), "records")
    placed = ranked(records.select(*KEYS, "ord", "asset_id", "_id"), KEYS, "_at", F.asc("ord"), F.asc("asset_id")).select("_id", "_at")
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    usable = has & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # exact copies resemble the same records: only the first of each takes part, unless it has no length
    key = F.when(F.exists("embedding", lambda x: x != 0.0), F.xxhash64("embedding"))
    marks = records.select(*KEYS, F.to_json("ctx").alias("path"), "_id", F.coalesce(usable, F.lit(False)).alias("_ok"), key.alias("_key"))
    marks = marks.join(unsent(placed), "_id").withColumn("_key", F.when(F.col("_ok"), F.coalesce("_key", "_at")))
    marks = settle(marks, "marks")
    nodes = marks.where("_ok").groupBy("branch", "path", "_key").agg(F.min("_at").alias("n"), F.min_by("_id", "_at").alias("_id"))
    nodes = settle(nodes, "nodes")
    vectors = records.select("_id", "embedding").join(unsent(nodes.drop("_key")), "_id").drop("_id")
    led = leaders(cosine_pairs(vectors, threshold, "branch", "path"), "branch", "path")
    of = nodes.select("branch", "path", "_key", "n").join(unsent(led), ["branch", "path", "n"], "left")
    of = of.select("branch", "path", "_key", F.coalesce("leader", "n").alias("_lead"))
    numbers = _numbered(marks.join(unsent(of), ["branch", "path", "_key"], "left"))
    return split(records.join(unsent(numbers), "_id"), name, "_g").drop("_id", "_g")


def by_near_vectors(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Groups of near-identical embeddings, each around its first record in list order; exact, with
    no limit on the number of neighbours. Records without a usable embedding follow as single ones."""
    return _by_vectors(df, "faiss", threshold)


def by_scene(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """As :func:`by_near_vectors`, at the similarity of one scene."""
    return _by_vectors(df, "cosine", threshold)


def evenly(df: DataFrame, number_of_partitions: int = 4) -> DataFrame:
    """Deal the records of each context in turn to so many groups, no more than it has records."""
    if number_of_partitions < 1:
        raise ValueError("number_of_partitions must be at least 1")
    placed = ranked(df, KEYS, "_at", F.asc("ord"), F.asc("asset_id"))
    counted = placed.join(df.groupBy(*KEYS).agg(F.count("*").alias("_n")), KEYS)
    groups = F.least(F.lit(number_of_partitions), F.col("_n"))
    return split(counted.withColumn("_g", F.col("_at") % groups), "evenly", "_g").drop("_g", "_at", "_n")


def sizes(df: DataFrame) -> DataFrame:
    """(``branch``, ``ctx``, ``n``): records of each context."""
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"))
