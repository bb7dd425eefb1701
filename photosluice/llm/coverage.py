"""A varied subset of a given size, by concave feature coverage.

Every record carries mass 1 of one feature, its kind (records similar to each other share one).
The objective is the sum over kinds of the square root of the selected mass, so a record adds
``sqrt(m + 1) - sqrt(m)`` to a kind of which ``m`` are selected: representing a new kind is always
worth more than repeating one. A threshold descends in rounds; each round adds the records whose
marginal gain exceeds it, given all those before them, to every request at once. The round that
would overfill a request adds the largest gains first, so that the result does not depend on how
fast the threshold descends.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photosluice.core.storage import settle
from photosluice.llm.density_clusters import FINISH_MOST, spanning_forest
from photosluice.llm.neighbours import _TIE
from photosluice.llm.vectors import DIM, looks_usable, pack, unit, usable_rows, vector_key

POOL_MOST = 8000  # records of a pool whose kinds one task finds exactly, about 3 MB of vectors
SALT = 32
DESCENT = 0.5  # by which the threshold is multiplied from round to round


def components(rows: np.ndarray, least: float, block: int = 1024) -> np.ndarray:
    """Smallest index of each row's component in the graph of cosines of ``least`` or more."""
    u = unit(rows)
    x = u.astype(np.float32)
    n, label, changed = len(x), np.arange(len(x)), True
    while changed:
        changed = False
        for s in range(0, n, block):
            sims = x[s : s + block] @ x.T
            mask = sims >= least
            i, j = np.nonzero(np.abs(sims - least) < _TIE)
            if len(i):
                mask[i, j] = np.einsum("ij,ij->i", u[i + s], u[j]) >= least
            mask[np.arange(len(mask)), np.arange(s, s + len(mask))] = True
            low = np.where(mask, label[None, :], n).min(axis=1)
            if (low < label[s : s + block]).any():
                changed = True
                # lower the label of the component's present root too
                np.minimum.at(label, label[s : s + block], low)
                label[s : s + block] = np.minimum(label[s : s + block], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _kinds_in_task(least: float, dim: int):
    def find(table: pa.Table) -> pa.Table:
        at, rows = usable_rows(table.column("vec").combine_chunks(), dim)
        kind = components(rows, least) if len(rows) else np.zeros(0, np.int64)
        take = pa.array(at)
        return pa.table(
            {
                "pool": table.column("pool").take(take),
                "id": table.column("id").take(take),
                "score": table.column("score").take(take),
                "kind": pa.array(kind.astype(np.int64)),
            }
        )

    return find


def joining_edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of hits that join whatever all hits of ``mask`` join: all of them if few, else a forest."""
    if np.count_nonzero(mask) <= 2 * sum(mask.shape):
        return np.nonzero(mask)
    rows, cols = [], []
    new_row, new_col = mask.any(axis=1), np.ones(mask.shape[1], bool)
    for start in range(len(mask)):
        if not new_row[start]:
            continue
        new_row[start] = False
        reached = np.array([start])
        while len(reached):
            # every row and every column is looked at once
            sub = mask[reached] & new_col
            c = np.flatnonzero(sub.any(axis=0))
            rows.append(reached[sub[:, c].argmax(axis=0)]), cols.append(c)
            new_col[c] = False
            open_rows = np.flatnonzero(new_row)
            sub = mask[np.ix_(open_rows, c)]
            hit = sub.any(axis=1)
            reached = open_rows[hit]
            rows.append(reached), cols.append(c[sub[hit].argmax(axis=1)] if len(c) else c)
            new_row[reached] = False
    return np.concatenate(rows), np.concatenate(cols)


def _kinds_of_large(large: DataFrame, least: float, block_rows: int, small: int, dim: int) -> DataFrame:
    """Kinds in pools too large for one task, exactly: distinct vectors in blocks, every two of which are compared."""
    keyed = large.withColumn("node", F.xxhash64("pool", vector_key("vec")))
    distinct = settle(keyed.select("pool", "node", "vec").dropDuplicates(["pool", "node"]), "vectors")
    blocks = distinct.groupBy("pool").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    own = distinct.join(blocks, "pool").withColumn("b", F.pmod("node", "blocks").cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.transform(other, lambda o: F.struct(F.least(o, F.col("b")).alias("lo"), F.greatest(o, F.col("b")).alias("hi")))
    dealt = own.select("pool", "node", "vec", "b", F.explode(meets).alias("m")).select("pool", "node", "vec", "b", "m.*")

    def compare(table: pa.Table) -> pa.Table:
        at, rows = usable_rows(table.column("vec").combine_chunks(), dim)
        node, block = (table.column(c).to_numpy()[at] for c in ("node", "b"))
        lo, hi = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("lo", "hi"))
        u = unit(rows) if len(rows) else rows
        x = u.astype(np.float32)
        mask = np.zeros((len(lo), len(hi)), bool)
        for s in range(0, len(lo), 512):
            sims = x[lo[s : s + 512]] @ x[hi].T
            mask[s : s + 512] = sims >= least
            i, j = np.nonzero(np.abs(sims - least) < _TIE)
            mask[s + i, j] = np.einsum("ij,ij->i", u[lo[s + i]], u[hi[j]]) >= least
        i, j = joining_edges(mask)
        return pa.table({"a": node[lo[i]], "b": node[hi[j]]})

    edges = dealt.groupBy("pool", "lo", "hi").applyInArrow(compare, "a long, b long")
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.0).alias("w")).where("a <> b").distinct()
    _, nodes = spanning_forest(flat, small)
    return (
        keyed.select("pool", "id", "score", "node")
        .join(nodes.select(F.col("h").alias("node"), "root"), "node", "left")
        .select("pool", "id", "score", F.coalesce("root", "node").alias("kind"))
    )


def kinds(
    pools: DataFrame,
    least: float = 0.86,
    pool_most: int = POOL_MOST,
    rows_per_partition: int = 6000,
    small: int = FINISH_MOST,
    dim: int = DIM,
) -> DataFrame:
    """(``pool``, ``id``, ``score``, ``kind``) for rows (``pool``, ``id``, ``score``, ``vec``), one a pool and id.

    Exact at every size; distinct vectors of a pool above ``pool_most`` are compared in pairs of
    blocks of about ``rows_per_partition``, so the work is quadratic in the pool.
    """
    rows = settle(pools.where(looks_usable("vec", dim)), "pool-rows")
    sizes = rows.groupBy("pool").count()
    large = sizes.where(F.col("count") > pool_most).select("pool")
    if not large.limit(1).count():
        return rows.groupBy("pool").applyInArrow(_kinds_in_task(least, dim), "pool string, id string, score double, kind long")
    few = rows.join(large, "pool", "left_anti").groupBy("pool").applyInArrow(_kinds_in_task(least, dim), "pool string, id string, score double, kind long")
    return few.unionByName(_kinds_of_large(rows.join(large, "pool", "left_semi"), least, rows_per_partition, small, dim))


def varied_subset(items: DataFrame, requests: DataFrame, descent: float = DESCENT) -> DataFrame:
    """(``request_id``, ``id``, ``gain``): the ``pick_size`` records of each request's pool that cover it best.

    ``items`` has (``pool``, ``id``, ``score``, ``kind``), ``requests`` (``request_id``, ``pool``,
    ``pick_size``). Records of equal gain are taken by score, descending, then id. A pool smaller
    than ``pick_size`` is taken whole; a request of an unknown pool, or of null or no size, gives
    no rows. A kind or pool that holds most rows is cut to what it can contribute in ``SALT``
    shares before it meets in one task.
    """
    requests = requests.where(F.col("pick_size") > 0).select("request_id", "pool", "pick_size")
    most = requests.groupBy("pool").agg(F.max("pick_size").alias("most"))
    salted = items.join(most, "pool").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    order = [F.desc("score"), F.asc("id")]
    share = Window.partitionBy("pool", "kind", "salt").orderBy(*order)
    cut = salted.withColumn("p", F.row_number().over(share)).where("p <= most").drop("p")
    # a kind's records in the order in which they are tried: `place` is the mass before them, and one
    placed = cut.withColumn("place", F.row_number().over(Window.partitionBy("pool", "kind").orderBy(*order))).where("place <= most")
    gain = F.sqrt("place") - F.sqrt(F.col("place") - 1)
    placed = settle(placed.select("pool", "id", "score", "place", gain.alias("gain")), "placed")
    levels = settle(placed.groupBy("pool", "gain").agg(F.count("*").alias("n")), "gains")
    # per request: what is still open, down to which gain all are added, and down to which some are
    state = requests.select("request_id", "pool", F.col("pick_size").cast("long").alias("room"), F.lit(2.0).alias("whole"), F.lit(None).cast("double").alias("some"))
    state, done, threshold = settle(state.join(levels.select("pool").distinct(), "pool", "left_semi"), "requests"), [], 1.0
    while state.limit(1).count():
        threshold *= descent
        reach = (F.col("gain") >= threshold) & (F.col("gain") < F.col("whole"))
        found = state.join(levels, "pool").groupBy("request_id", "pool", "room", "whole").agg(
            F.sum(F.when(reach, F.col("n")).otherwise(0)).alias("n"), F.min("gain").alias("least")
        )
        full = F.col("n") > F.col("room")
        after = found.select(
            "request_id", "pool",
            F.when(full, F.col("room")).otherwise(F.col("room") - F.col("n")).alias("room"),
            F.when(full, F.col("whole")).otherwise(F.lit(threshold)).alias("whole"),
            F.when(full, F.lit(threshold)).alias("some"),
            (full | (F.col("n") == F.col("room")) | (F.col("least") >= threshold)).alias("end"),
        )
        after = settle(after, "round")
        done.append(after.where("end").drop("end"))
        state = after.where("not end").drop("end")
    if not done:
        return placed.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "id", "gain").limit(0)
    taken = placed.join(reduce(DataFrame.unionByName, done), "pool")
    whole = taken.where("gain >= whole")
    # rows beyond the room of the last round go before its records meet: first in shares, then whole
    last = taken.where("gain < whole and gain >= some").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    order = [F.desc("gain"), *order]
    last = last.withColumn("p", F.row_number().over(Window.partitionBy("request_id", "salt").orderBy(*order))).where("p <= room")
    last = last.withColumn("p", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where("p <= room")
    return whole.select("request_id", "id", "gain").unionByName(last.select("request_id", "id", "gain"))


def pick_varied(requests: DataFrame, contexts: DataFrame, assets: DataFrame, **params) -> DataFrame:
    """(``request_id``, ``asset_id``, ``gain``) for requests over contexts of assets.

    The pool of a request is the assets of its ``partition_id`` whose embedding is usable; an asset
    counts once, however often it or its membership was delivered. Null and NaN scores count as 0,
    others are limited to 0..1. Null ids never match. Empty tables give no rows.
    """
    wanted = requests.select("request_id", F.col("partition_id").alias("pool"), "pick_size")
    member = contexts.select(F.col("partition_id").alias("pool"), F.col("asset_id").alias("id"))
    member = member.join(wanted.select("pool").distinct(), "pool", "left_semi").distinct()
    s = F.col("score")
    clean = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    known = assets.select(F.col("asset_id").alias("id"), clean.alias("score"), F.col("embedding").alias("vec")).where(looks_usable("vec"))
    pools = member.join(known, "id").select("pool", "id", "score", "vec").dropDuplicates(["pool", "id"])
    picked = varied_subset(kinds(pools, **params), wanted)
    return picked.select("request_id", F.col("id").alias("asset_id"), "gain")


def cover_by_rounds(items: DataFrame, features: DataFrame, requests: DataFrame, epsilon: float = 0.2) -> DataFrame:
    """(``request_id``, ``id``, ``round``, ``gain``): as :func:`varied_subset`, for records with any number of features.

    ``items`` has (``pool``, ``id``, ``score``), ``features`` (``pool``, ``id``, ``feature``,
    ``mass``), ``mass`` above 0. The sum over features of the square root of the selected mass is
    raised in rounds: a threshold begins at a request's best gain and falls by ``epsilon`` or to
    the best gain left; each round adds, in order of score and id, the records whose gain reaches
    it even after all those before them in the round. Records that add nothing follow by score
    only if room is left. Ends when every request is full: each round adds at least its best record.
    """
    wanted = requests.where("pick_size > 0 and pool is not null").select("request_id", "pool", "pick_size")
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")).alias("rank")
    open_items = settle(items.join(wanted, "pool").select("request_id", "pick_size", "pool", "id", rank).dropDuplicates(["request_id", "id"]), "open")
    weights = features.where("mass > 0").groupBy("pool", "id", "feature").agg(F.max("mass").alias("mass"))
    weights = settle(weights.join(wanted.select("request_id", "pool"), "pool").select("request_id", "id", "feature", "mass"), "weights")
    room = settle(wanted.select("request_id", F.col("pick_size").cast("long").alias("room")), "room")
    total = weights.select("request_id", "feature").distinct().withColumn("total", F.lit(0.0))
    levels, out = None, []
    added = lambda have, more: F.sqrt(have + more) - F.sqrt(have)
    for number in count():
        live = open_items.join(room.where("room > 0"), "request_id").select("request_id", "id", "rank", "room")
        held = live.join(weights, ["request_id", "id"]).join(total, ["request_id", "feature"])
        gains = held.groupBy("request_id", "id", "rank", "room").agg(F.sum(added(F.col("total"), F.col("mass"))).alias("gain"))
        gains = settle(gains, "gains")
        best = gains.groupBy("request_id").agg(F.max("gain").alias("best"))
        if best.limit(1).count() == 0:
            break
        if levels is None:
            levels = best.select("request_id", F.col("best").alias("level"))
        else:
            lower = F.least("best", F.when(F.col("best") >= F.col("level"), F.col("level")).otherwise(F.col("level") * (1 - epsilon)))
            levels = best.join(levels, "request_id").select("request_id", lower.alias("level"))
        levels = settle(levels, "levels")
        fit = gains.join(levels, "request_id").where("gain >= level")
        # of one feature, a round can't use more records than there is room for
        each = fit.join(weights, ["request_id", "id"]).join(total, ["request_id", "feature"])
        in_feature = Window.partitionBy("request_id", "feature").orderBy("rank")
        each = each.withColumn("n", F.row_number().over(in_feature))
        before = F.coalesce(F.sum("mass").over(in_feature.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        each = each.withColumn("after", F.when(F.col("n") <= F.col("room"), added(F.col("total") + before, F.col("mass"))).otherwise(0.0))
        sure = each.groupBy("request_id", "id", "rank", "room", "level").agg(F.sum("after").alias("gain")).where("gain >= level * (1 - 1e-9)")
        took = sure.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("rank"))).where("n <= room")
        took = settle(took.select("request_id", "id", F.lit(number).alias("round"), "gain"), "took")
        out.append(took)
        more = took.join(weights, ["request_id", "id"]).groupBy("request_id", "feature").agg(F.sum("mass").alias("more"))
        total = settle(total.join(more, ["request_id", "feature"], "left").select("request_id", "feature", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")), "total")
        counts = took.groupBy("request_id").agg(F.count("*").alias("used"))
        room = settle(room.join(counts, "request_id", "left").select("request_id", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), "room")
        open_items = settle(open_items.join(took.select("request_id", "id"), ["request_id", "id"], "left_anti"), "open")
    rest = open_items.join(room.where("room > 0"), "request_id")
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("rank"))).where("n <= room")
    chosen = rest.select("request_id", "id", F.lit(None).cast("int").alias("round"), F.lit(0.0).alias("gain"))
    for t in out:
        chosen = chosen.unionByName(t)
    return chosen
