"""Choosing records within contexts: the best, the top, by month quota, diverse, not shown lately."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photosluice.functions.scalars import bits_of_hash, cosine, most_distance, parse_day, pick_limit, unit_score
from photosluice.core.storage import settle, unsent
from photosluice.operators.frames import KEYS, columns_or_null, in_context, ranked, union_all
from photosluice.operators.similarity import hamming_join, hamming_pairs, leaders
from photosluice.sources.library import as_day


ROUNDS_MOST = 8  # picks up to which all contexts are picked from in rounds
ONE_TASK = 20_000  # records of a context that one task picks from, about 15 MB


def _size(df: DataFrame) -> Column:
    """File size noted in the picture itself, 0 if unknown."""
    return F.coalesce("exif_size", F.lit(0))


def best(df: DataFrame, max_scale: float = 1.0) -> DataFrame:
    """The best record of each context, flagged ``group_best``.

    Best is the mean of sharpness (0 where unknown) and score, then the larger file, then the
    smaller id.
    """
    df = columns_or_null(df, sharpness="double", exif_size="long")
    value = unit_score("sharpness") * 0.5 + unit_score("score") * 0.5
    w = in_context().orderBy(F.desc(value), F.desc(_size(df)), F.asc("asset_id"), F.asc("ord"))
    top = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return top.withColumn("group_best", F.lit(True))


def top_n(df: DataFrame, count: int = 10) -> DataFrame:
    """The ``count`` records of highest score, then larger file, then list order; they become the list order."""
    df = columns_or_null(df, exif_size="long")
    w = in_context().orderBy(F.desc(unit_score("score")), F.desc(_size(df)), F.asc("ord"), F.asc("asset_id"))
    ranked = df.withColumn("_r", F.row_number().over(w).cast("bigint")).where(F.col("_r") <= count)
    above = F.transform("ctx", lambda x: x["idx"])
    return ranked.withColumn("ord", F.concat(above, F.array(F.col("_r") - 1))).drop("_r")


def balanced(df: DataFrame, min_photos: int = 300, max_photos: int = 500) -> DataFrame:
    """Between ``min_photos`` and ``max_photos`` records of each context, spread over its months.

    Every month (UTC) gives its best ``max(1, min // months)``; what is missing to the maximum
    comes from all others, untimed ones included, by score; if the quotas alone exceed the
    maximum, the lowest scores go. Equal scores are decided by the month that appears first, then
    list order, which the result keeps. Chosen records are flagged ``selected``.
    """
    low = min(min_photos, max_photos)
    score = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    utc = F.to_utc_timestamp("captured_at", F.current_timezone())
    df = df.withColumns({"_s": score, "_month": F.coalesce(F.date_format(utc, "yyyy-MM"), F.lit("-"))})
    months = df.groupBy(*KEYS, "_month").agg(F.min(F.struct("ord", "asset_id")).alias("_first"))
    seen = months.where("_month <> '-'").groupBy(*KEYS).agg(F.count("*").alias("_months"))
    # beyond its first `max_photos` a month can't contribute
    month = Window.partitionBy(*KEYS, "_month").orderBy(F.desc("_s"), F.asc("ord"), F.asc("asset_id"))
    df = df.withColumn("_place", F.row_number().over(month)).where(F.col("_place") <= max_photos)
    df = df.join(months, [*KEYS, "_month"]).join(seen, KEYS, "left")
    quota = F.greatest(F.lit(1), F.floor(F.lit(low) / F.col("_months")))
    df = df.withColumn("_due", (F.col("_month") != "-") & (F.col("_place") <= quota))
    # within the quota first, then the rest; untimed records after the timed of equal score
    late = F.when(F.col("_month") == "-", 1).otherwise(0)
    w = in_context().orderBy(F.desc("_due"), F.desc("_s"), F.asc(late), F.asc("_first"), F.asc("ord"), F.asc("asset_id"))
    chosen = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_photos)
    return chosen.drop("_s", "_month", "_first", "_months", "_due", "_r", "_place").withColumn("selected", F.lit(True))


def _mmr(max_picks: int, share: float, quality: float, diversity: float):
    """Positions picked in one context by maximal marginal relevance, in order of picking."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("asset_id", kind="stable")
        score = group["score"].to_numpy(float)
        n = len(score)
        limit = min(max_picks, max(1, int(np.ceil(share * n))), n)
        vectors = group["embedding"]
        known = np.array([v is not None and len(v) > 0 and bool(np.isfinite(np.asarray(v, float)).all()) for v in vectors])
        if known.any():
            width = {len(v) for v, k in zip(vectors, known) if k}
            if len(width) > 1:
                raise ValueError(f"embeddings of different sizes in one context: {sorted(width)}")
            x = np.zeros((n, width.pop()))
            x[known] = np.stack([np.asarray(v, float) for v, k in zip(vectors, known) if k])
            length = np.linalg.norm(x, axis=1)
            known &= length > 0  # a vector of no length says nothing
            x /= np.where(length > 0, length, 1)[:, None]
        spread = score.max() - score.min()
        level = (score - score.min()) / spread if spread > 0 else np.ones(n)
        order = [int(np.argmax(score))]
        nearest = np.full(n, -np.inf)
        left = np.ones(n, bool)
        left[order[0]] = False
        while len(order) < limit:
            if not known.any():
                value = score.copy()
            else:
                last = order[-1]
                if known[last]:
                    nearest = np.maximum(nearest, x @ x[last])
                value = quality * level + diversity * np.where(known, 1 - np.maximum(nearest, 0), 0.0)
                value = np.round(value, 12)
            value[~left] = -np.inf
            order.append(int(np.argmax(value)))
            left[order[-1]] = False
        out = group.iloc[order][["branch", "path", "pos"]].copy()
        out["turn"] = np.arange(len(order))
        return out

    return pick


def diverse_pick(
    df: DataFrame, max_picks: int = 3, pick_percentage: float = 0.33, quality_weight: float = 0.3, diversity_weight: float = 0.7
) -> DataFrame:
    """Good and dissimilar records of each context, in order of picking.

    First the best score (smaller id on ties); then, again and again, the largest weighted sum of
    score (scaled to the context's range) and of distance to the nearest pick. Records without an
    embedding add no diversity; without any embedding, scores decide. At most ``max_picks`` and
    the given share of the context. An embedding with numbers that are not finite, or of no length, counts as none;
    embeddings of different sizes in one context are an error. Flags: ``group_pick``, and ``group_best`` for the first.
    """
    columns = df.columns
    rows = settle(ranked(df, KEYS, "pos", F.asc("ord"), F.asc("asset_id")).withColumn("path", F.to_json("ctx")), "scenes")
    counts = rows.groupBy("branch", "path").agg(F.count("*").alias("_n"))
    inputs = rows.select("branch", "path", "pos", "asset_id", unit_score("score").alias("score"), "embedding").join(counts, ["branch", "path"])
    alone = inputs.where("_n = 1").select("branch", "path", "pos", F.lit(0).cast("long").alias("turn"))
    # few rounds over all contexts cost less than a call a context
    one_task = ONE_TASK if max_picks > ROUNDS_MOST else 1
    few, many = inputs.where((F.col("_n") > 1) & (F.col("_n") <= one_task)).drop("_n"), inputs.where((F.col("_n") > one_task) & (F.col("_n") > 1))
    picks = few.groupBy("branch", "path").applyInPandas(
        _mmr(max_picks, pick_percentage, quality_weight, diversity_weight), "branch string, path string, pos long, turn long"
    )
    picks = picks.unionByName(alone) if one_task > 1 else alone
    if counts.where((F.col("_n") > one_task) & (F.col("_n") > 1)).limit(1).count():
        picks = picks.unionByName(_mmr_rounds(many, max_picks, pick_percentage, quality_weight, diversity_weight))
    picks = settle(picks, "picks")
    above = F.transform("ctx", lambda x: x["idx"])
    chosen = rows.join(unsent(picks), ["branch", "path", "pos"])
    flagged = chosen.withColumns({"ord": F.concat(above, F.array("turn")), "group_pick": F.lit(True), "group_best": F.col("turn") == 0})
    return flagged.select(*columns, "group_pick", *([] if "group_best" in columns else ["group_best"]))


def _mmr_rounds(rows: DataFrame, max_picks: int, share: float, quality: float, diversity: float) -> DataFrame:
    """As :func:`_mmr` for contexts too large for one task: each round picks the best of every context."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0.0), F.lit(False))
    sizes = F.collect_set(F.when(known, F.size("embedding")))
    whole = F.when(F.size(sizes) > 1, F.raise_error(F.concat(F.lit("embeddings of different sizes in one context: "), F.to_json(F.array_sort(sizes))))).otherwise(True)
    stats = rows.groupBy("branch", "path").agg(
        whole.alias("whole"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.max(known).alias("any"), pick_limit(F.count("*"), max_picks, share).alias("limit")
    )
    level = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    state = rows.drop("_n").join(stats, ["branch", "path"]).where("whole").drop("whole").withColumns({"level": level, "known": known, "nearest": F.lit(0.0)}).drop("lo", "hi")
    state, out = settle(state, "round"), []
    for turn in range(max_picks):
        marginal = quality * F.col("level") + diversity * F.when(F.col("known"), 1 - F.col("nearest")).otherwise(0.0)
        value = F.col("score") if turn == 0 else F.round(F.when(F.col("any"), marginal).otherwise(F.col("score")), 12)
        best_key = F.struct((-value).alias("v"), "asset_id", "pos")
        open_rows = state.where(F.col("limit") > turn)
        picked = settle(open_rows.groupBy("branch", "path").agg(F.min(best_key).alias("k"), F.min_by("embedding", best_key).alias("pick")), "pick")
        out.append(picked.select("branch", "path", F.col("k.pos").alias("pos"), F.lit(turn).cast("long").alias("turn")))
        near = F.when(F.col("known") & (F.size("pick") > 0), cosine("embedding", "pick"))
        near = F.when(~F.isnan(near), near)
        state = open_rows.join(picked.select("branch", "path", F.col("k.pos").alias("_p"), "pick"), ["branch", "path"]).where("pos <> _p")
        state = settle(state.withColumn("nearest", F.greatest("nearest", F.coalesce(near, F.lit(0.0)))).drop("_p", "pick"), "round")
    return union_all(out)


def avoid_repeat(df: DataFrame, run_date: date | str, days: int = 30, photo_count: int = 500, history: DataFrame | None = None) -> DataFrame:
    """Records not shown in the last ``days`` days, filled up with those shown longest ago.

    A record is fresh if it was never shown or last shown on the cutoff day or before; fresh ones
    are all kept. If there are fewer than ``photo_count``, the others follow, oldest first, flagged
    ``fallback_backfilled``. ``history`` has (``asset_id``, ``last_shown``), one row a record; a
    date of the record's own (``last_shown_date``) goes first. List order stays.
    """
    if days <= 0:
        return df
    cutoff = F.lit(as_day(run_date) - timedelta(days=days))
    df = columns_or_null(df, last_shown_date="string")
    own = parse_day(F.col("last_shown_date").cast("string"))
    if history is not None:
        df = df.join(history.select("asset_id", F.col("last_shown").alias("_shown")), "asset_id", "left")
        own = F.coalesce(own, "_shown")
    df = df.withColumn("_last", own)
    fresh = F.col("_last").isNull() | (F.col("_last") <= cutoff)
    df = df.withColumn("fallback_backfilled", ~fresh)
    new = df.where("not fallback_backfilled")
    counts = new.groupBy(*KEYS).agg(F.count("*").alias("_have"))
    turn = F.row_number().over(in_context().orderBy(F.asc("_last"), F.asc("asset_id"), F.asc("ord")))
    old = df.where("fallback_backfilled").withColumn("_turn", turn).where(F.col("_turn") <= photo_count)
    old = old.join(counts, KEYS, "left").where(F.col("_turn") <= F.lit(photo_count) - F.coalesce("_have", F.lit(0)))
    return new.unionByName(old.drop("_turn", "_have")).drop("_shown", "_last")


def hash_duplicates(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(``branch``, ``ctx``, ``_at``, ``lead``): records with a similar one on the same day or across midnight.

    Days are UTC; records of the last hour of a day are also compared with those of the first hour
    of the next that are at most an hour later. ``_at`` is the position by time and id, ``lead``
    that of the first record of its group; records without time or hash, and those alone, are left
    out.
    """
    utc = F.to_utc_timestamp("captured_at", F.current_timezone())
    rows = df.withColumns({"_bits": bits_of_hash("phash"), "_day": F.datediff(utc, F.lit("1970-01-01")), "_us": F.unix_micros("captured_at"), "path": F.to_json("ctx")})
    rows = rows.where("_bits is not null and _us is not null").select("branch", "path", "_at", "_bits", "_day", "_us")
    most = most_distance(threshold)
    hour = 3_600_000_000
    into = lambda c: F.pmod(F.col(c), F.lit(24 * hour))
    # Records of a day with the same hash resemble the same ones, but for those of the day before, which
    # only the first hour can reach: of equal hashes after it, and of equal times in it, the first stands for all.
    rows = rows.withColumn("_t", F.when(into("_us") <= hour, F.col("_us")).otherwise(F.lit(-1)))
    same = ["branch", "path", "_day", "_bits", "_t"]
    first = rows.groupBy(*same).agg(F.min("_at").alias("n"), F.min_by("_us", "_at").alias("us"), F.count("*").alias("copies"))
    first = settle(first, "hashes")
    nodes = first.select("branch", "path", "_day", "n", F.col("_bits").alias("bits"))
    same_day = hamming_pairs(nodes, most, "branch", "path", "_day").select("branch", "path", "i", "j")
    ends = first.select("branch", "path", F.col("_day").alias("d"), F.col("_bits").alias("bits"), "n", F.col("us").alias("t"))
    late, early = ends.where(into("t") >= 23 * hour), ends.where(into("t") <= hour).withColumn("d", F.col("d") - 1)
    bridge = hamming_join(late, early, most, ["branch", "path", "d"]).where(F.col("tj") - F.col("ti") <= hour).select("branch", "path", "i", "j")
    pairs = same_day.unionByName(bridge)
    led = leaders(pairs.select("branch", "path", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct(), "branch", "path")
    of = first.join(unsent(led), ["branch", "path", "n"], "left").where("copies > 1 or leader is not null")
    return rows.join(unsent(of.select(*same, F.coalesce("leader", "n").alias("leader"))), same).select("branch", "path", F.col("_at").alias("n"), "leader")


def drop_hash_duplicates(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Keep the best of every group of records with similar hashes shot on a day or across midnight.

    Groups form around the first record by time and id. The highest score stays, on ties the
    smaller id, and bears ``group_id``; losers are removed by id.
    """
    rows = ranked(df, KEYS, "_at", F.asc_nulls_last("captured_at"), F.asc("asset_id"), F.asc("ord"))
    rows = settle(rows.withColumn("path", F.to_json("ctx")), "timed")
    groups = settle(hash_duplicates(rows, threshold).select("branch", "path", F.col("n").alias("_at"), "leader"), "groups")
    members = rows.select(*KEYS, "path", "_at", "asset_id", unit_score("score").alias("_s")).join(unsent(groups), ["branch", "path", "_at"])
    winners = members.groupBy(*KEYS, "path", "leader").agg(F.min(F.struct((-F.col("_s")).alias("s"), "asset_id", "_at")).alias("w"))
    numbered = ranked(winners.select(*KEYS, "path", "leader", F.col("w.asset_id").alias("_winner"), F.col("w._at").alias("_at")), KEYS, "_number", F.asc("leader"))
    numbered = settle(numbered, "winners")
    losers = members.join(unsent(numbered.select("branch", "path", "leader", F.col("_at").alias("_best"))), ["branch", "path", "leader"]).where("_at <> _best")
    kept = rows.join(unsent(losers.select("branch", "path", "asset_id").distinct()), ["branch", "path", "asset_id"], "left_anti")
    named = numbered.select("branch", "path", "_at", F.concat(F.lit("phash:"), F.col("_number").cast("string")).alias("group_id"))
    return kept.drop("group_id").join(unsent(named), ["branch", "path", "_at"], "left").drop("_at", "path")
