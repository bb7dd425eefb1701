import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from photosluice.functions.scalars import hamming, haversine, most_distance
from photosluice.core.storage import settle
from photosluice.operators import frames, partition, select
from photosluice.operators.frames import asset_frame, context_id, merge
from photosluice.operators.similarity import BLOCKS, _alike, _bands, cosine_pairs, hamming_join, hamming_pairs, leaders


def groups(df):
    out = defaultdict(list)
    for r in df.orderBy("ord", "asset_id").select("ctx", "asset_id").collect():
        out[tuple(x["idx"] for x in r["ctx"])].append(r["asset_id"])
    return [v for _, v in sorted(out.items())]


def ids(df):
    return sorted(r["asset_id"] for r in df.select("asset_id").collect())


def test_distances(spark):
    r = spark.range(1).select(
        haversine(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("far"),
        haversine(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0)).alias("near"),
        hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")).alias("all"),
    ).first()
    assert 340_000 < r["far"] < 345_000 and 100 < r["near"] < 120 and r["all"] == 64
    assert most_distance(0.9) == 6


def test_time_gaps(assets):
    times = {"b": "2024-01-01T10:05:00", "a": "2024-01-01T10:00:00", "c": "2024-01-01T10:10:00.000001", "d": None, "e": "2024-01-02T00:00:00"}
    df = asset_frame(assets(*[{"asset_id": k, "captured_at": v} for k, v in times.items()]))
    out = partition.by_time(df, 5)
    assert groups(out) == [["a", "b"], ["c"], ["e"], ["d"]]
    assert ids(merge(out)) == list("abcde") and groups(merge(out)) == [["a", "b", "c", "e", "d"]]
    assert groups(partition.by_time(df.where("asset_id = 'd'"), 5)) == [["d"]]
    assert groups(partition.by_time(df.limit(0), 5)) == []


def test_time_gaps_against_a_model(assets):
    rng = random.Random(5)
    rows = [{"asset_id": f"{i:03}", "captured_at": None if rng.random() < 0.1 else f"2024-01-01T{rng.randrange(24):02}:{rng.randrange(60):02}:00", "album_id": rng.choice("xyz")} for i in range(200)]
    from photosluice.operators.frames import split

    df = split(asset_frame(assets(*rows)), F.col("album_id"), F.ascii("album_id"))
    want = []
    for album in "xyz":
        own = sorted((at(r["captured_at"]), r["asset_id"]) for r in rows if r["album_id"] == album and r["captured_at"])
        last = None
        for t, i in own:
            if last is None or (t - last).total_seconds() > 600:
                want.append([])
            want[-1].append(i)
            last = t
        rest = sorted(r["asset_id"] for r in rows if r["album_id"] == album and not r["captured_at"])
        if rest:
            want.append(rest)
    assert groups(partition.by_time(df, 10)) == want


def test_time_and_place(assets):
    rows = [("a", 0, 0.0), ("b", 1, 0.0005), ("c", 2, 0.01), ("d", 3, None), ("e", 4, 0.01), ("f", 30, 0.01)]
    df = asset_frame(assets(*[{"asset_id": i, "captured_at": f"2024-01-01T10:{m:02}:00", "latitude": y, "longitude": 0.0 if y is not None else None} for i, m, y in rows]))
    assert groups(partition.by_time_and_place(df, 5, 100)) == [["a", "b"], ["c"], ["d"], ["e"], ["f"]]


def test_anchors(assets):
    # b is near a; c is near b but not near a; d is at a's place; e has none
    rows = [("a", 0, 0.0), ("b", 1, 0.0008), ("c", 2, 0.0016), ("d", 3, 0.0), ("e", 4, None), ("f", 40, None), ("g", None, 0.0)]
    df = asset_frame(
        assets(*[{"asset_id": i, "captured_at": None if m is None else f"2024-01-01T10:{m:02}:00", "latitude": y, "longitude": None if y is None else 0.0} for i, m, y in rows])
    )
    assert groups(partition.by_time_and_anchor(df, 5, 100)) == [["a", "b", "d"], ["c"], ["e"], ["f"], ["g"]]


def test_anchors_against_a_model(assets):
    rng = random.Random(3)
    rows = [{"asset_id": f"{i:03}", "captured_at": f"2024-01-01T{i // 40:02}:{i % 40:02}:00", "latitude": rng.randrange(6) * 0.0005 if rng.random() < 0.9 else None, "longitude": rng.randrange(3) * 0.0005} for i in range(120)]
    want = []
    for burst in range(3):
        made, lost = [], []
        for r in rows[burst * 40 : burst * 40 + 40]:
            if r["latitude"] is None:
                lost.append(r["asset_id"])
                continue
            for g in made:
                p1, p2 = math.radians(g[0][0]), math.radians(r["latitude"])
                dl = math.radians(r["longitude"] - g[0][1])
                q = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
                if 2 * 6371000 * math.atan2(math.sqrt(q), math.sqrt(1 - q)) <= 100:
                    g[1].append(r["asset_id"])
                    break
            else:
                made.append(((r["latitude"], r["longitude"]), [r["asset_id"]]))
        want += [g for _, g in made] + ([lost] if lost else [])
    assert groups(partition.by_time_and_anchor(asset_frame(assets(*rows)), 5, 100)) == want


H = lambda x: f"{x:016x}"


@pytest.mark.parametrize(
    "hashes, want",
    [
        ([H(0), H(0)], [["0", "1"]]),
        ([H(0), H(2**64 - 1)], [["0"], ["1"]]),
        ([H(0), H(1), H(3)], [["0", "1", "2"]]),
        ([H(0), H(0xF), H(0xFF)], [["0", "1"], ["2"]]),
        ([H(0), H(0x3F)], [["0", "1"]]),
        ([H(0), H(0x7F)], [["0"], ["1"]]),
        ([H(0), None, H(1), ""], [["0", "2"], ["1"], ["3"]]),
    ],
)
def test_hash_groups(assets, hashes, want):
    df = asset_frame(assets(*[{"asset_id": str(i), "phash": h} for i, h in enumerate(hashes)]))
    assert groups(partition.by_hash(df)) == want


def leader_model(n, similar):
    lead, out = [], []
    for i in range(n):
        g = next((a for a in lead if similar(a, i)), None)
        if g is None:
            lead.append(i)
            g = i
        out.append(g)
    return out


def test_leaders_against_a_model(spark):
    rng = random.Random(1)
    for n, p in ((30, 0.1), (40, 0.3), (25, 0.02)):
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p}
        want = leader_model(n, lambda a, i, e=edges: (a, i) in e)
        df = spark.createDataFrame([("k", i, j) for i, j in edges], "k string, i long, j long")
        got = {r["n"]: r["leader"] for r in leaders(df, "k").collect()}
        assert [got.get(i, i) for i in range(n)] == want


def test_leaders_send_no_table_through_the_driver(spark):
    chain = spark.range(2000).selectExpr("'k' as k", "id as i", "id + 2000 as j")
    plan = leaders(chain, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(12)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "n long, bits long")
    for most in (0, 6, 13):
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(values[i] ^ values[j]).count("1") <= most}
        assert {(r["i"], r["j"]) for r in hamming_pairs(df, most).collect()} == want


def test_hamming_pairs_of_large_groups_shuffle_few_copies(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(6)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([("a" if i % 3 else "b", f"{i:03}", s) for i, s in enumerate(signed)], "k string, n string, bits long")
    for most in (0, 6, 13):
        want = {(f"{i:03}", f"{j:03}") for i in range(240) for j in range(i + 1, 240) if bool(i % 3) == bool(j % 3) and bin(values[i] ^ values[j]).count("1") <= most}
        for compared in (10, 1000):
            got = [(r["i"], r["j"]) for r in hamming_pairs(df, most, "k", compared=compared).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    for r in (1, 2, 3):
        # so many combinations of bands went through the shuffle before, of which r = 3 has 84
        bands, taken = _bands(6, {1: 100, 2: 100_000, 3: 10**9}[r], 64)
        assert taken == r and len(bands) - taken + 1 == 7


def test_hamming_join_of_two_sides(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "d int, n long, bits long, t long")
    late, early = rows((1, 5, 0, 50), (1, 6, -1, 60), (2, 7, 0, 70)), rows((1, 1, 1, 10), (1, 2, 3, 20), (3, 3, 0, 30))
    for compared in (1, 100):
        got = sorted(tuple(r) for r in hamming_join(late, early, 1, ["d"], compared=compared).select("d", "i", "j", "ti", "tj").collect())
        assert got == [(1, 5, 1, 50, 10)]


def test_cosine_pairs_over_blocks(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(vectors)], "k string, n long, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) * math.hypot(*b)) or 1)
    want = {(i, j) for i in range(41) for j in range(i + 1, 41) if cos(vectors[i], vectors[j]) >= 0.6 and any(vectors[j])}
    assert {(r["i"], r["j"]) for r in cosine_pairs(df, 0.6, "k", block_rows=7).collect()} == want


def test_cosine_pairs_of_a_large_group_go_through_few_blocks(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(150)]
    df = spark.createDataFrame([("a" if i < 120 else "b", i, v) for i, v in enumerate(vectors)], "k string, n long, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    want = sorted((i, j) for i in range(150) for j in range(i + 1, 150) if (i < 120) == (j < 120) and cos(vectors[i], vectors[j]) >= 0.7)
    pairs = cosine_pairs(df, 0.7, "k", block_rows=2)
    assert sorted((r["i"], r["j"]) for r in pairs.collect()) == want
    # with blocks of two, group a alone had 60 blocks, and each vector as many copies
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and BLOCKS == 8
    mixed = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0, 0.0]), ("b", 0, [1.0])], "k string, n long, embedding array<float>")
    with pytest.raises(Exception, match="different sizes"):
        cosine_pairs(mixed, 0.5, "k").collect()


def test_pairs_of_a_dense_group_come_in_small_parts():
    x = np.full((900, 4), 0.5)
    zero = np.zeros(1, np.int64)
    parts = list(_alike(x, zero, zero + 900, np.zeros(900, np.int64), zero, zero, 0.9))
    assert sum(len(i) for i, _, _ in parts) == 900 * 899 // 2 and max(len(i) for i, _, _ in parts) <= 1 << 15
    assert len({(a, b) for i, j, _ in parts for a, b in zip(i.tolist(), j.tolist())}) == 900 * 899 // 2


def test_vector_groups(assets):
    vectors = [[1.0, 0.0], [0.99, 0.01], [0.0, 1.0], None, [2.0, 0.0], [float("nan"), 1.0], [0.0, 0.0], []]
    df = asset_frame(assets(*[{"asset_id": str(i), "embedding": v} for i, v in enumerate(vectors)]))
    assert groups(partition.by_near_vectors(df)) == [["0", "1", "4"], ["2"], ["6"], ["3"], ["5"], ["7"]]


def test_positions_of_vector_groups_are_found_without_the_vectors(assets, monkeypatch):
    wide = []
    monkeypatch.setattr(partition, "settle", lambda df, name: wide.append((name, "embedding" in df.columns)) or settle(df, name))
    monkeypatch.setattr(frames, "settle", lambda df, name: wide.append((name, "embedding" in df.columns)) or settle(df, name))
    df = asset_frame(assets({"asset_id": "a", "embedding": [1.0, 0.0]}, {"asset_id": "b", "embedding": [1.0, 0.1]}, {"asset_id": "c"}))
    assert groups(partition.by_scene(df)) == [["a", "b"], ["c"]]
    assert [name for name, has in wide if has] == ["records"]


@pytest.mark.parametrize("stage", [partition.by_hash, partition.by_near_vectors, partition.by_time_and_anchor, select.diverse_pick])
def test_what_a_stage_returns_reads_two_tables(assets, stage):
    """Else each stage of a composite plans all those before it again, in the driver's memory."""
    rows = [{"asset_id": i, "phash": H(k), "embedding": [1.0, 0.1 * k], "latitude": 10.0, "longitude": 20.0 + k, "score": 0.5} for k, i in enumerate("abcd")]
    plan = stage(asset_frame(assets(*rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "BroadcastHashJoin" not in plan


def test_positions_of_hash_groups_are_found_without_the_vectors(assets, monkeypatch):
    seen = []
    monkeypatch.setattr(frames, "settle", lambda df, name: seen.append(df.columns) or settle(df, name))
    partition.by_hash(asset_frame(assets({"asset_id": "a", "phash": H(1), "embedding": [1.0, 0.0]}, {"asset_id": "b", "phash": None, "embedding": None}))).count()
    assert seen and not any("embedding" in c for c in seen)


def test_evenly(assets):
    df = asset_frame(assets(*[{"asset_id": str(i)} for i in range(5)]))
    assert groups(partition.evenly(df, 2)) == [["0", "2", "4"], ["1", "3"]]
    assert len(groups(partition.evenly(df, 9))) == 5
    with pytest.raises(ValueError):
        partition.evenly(df, 0)


def test_context_ids(assets):
    df = partition.evenly(asset_frame(assets({"asset_id": "a"}, {"asset_id": "b"})), 2)
    assert sorted(r["i"] for r in df.select(context_id().alias("i")).collect()) == ["root__evenly_0", "root__evenly_1"]


def test_best_and_top(assets):
    df = asset_frame(assets({"asset_id": "z", "score": 0.8}, {"asset_id": "a", "score": 0.8}, {"asset_id": "m", "score": None}, {"asset_id": "n", "score": float("nan")}))
    assert ids(select.best(df)) == ["a"]
    big = df.withColumn("exif_size", F.when(F.col("asset_id") == "z", 9).otherwise(1).cast("long"))
    assert ids(select.best(big)) == ["z"]
    assert [r["asset_id"] for r in select.top_n(big, 3).orderBy("ord").collect()] == ["z", "a", "m"]


def balanced_model(rows, low, high):
    low = min(low, high)
    month = {i: t[:7] if t else None for i, t, _ in rows}
    score = {i: s or 0.0 for i, _, s in rows}
    order = [i for i, _, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))]
    months = list(dict.fromkeys(m for i in order if (m := month[i])))
    picked = []
    if months:
        quota = max(1, low // len(months))
        for m in months:
            picked += sorted((i for i in order if month[i] == m), key=lambda i: -score[i])[:quota]
    rest = [i for m in months for i in sorted((i for i in order if month[i] == m), key=lambda i: -score[i]) if i not in picked]
    rest = sorted(rest + sorted((i for i in order if month[i] is None), key=lambda i: -score[i]), key=lambda i: -score[i])
    picked += rest[: max(0, high - len(picked))]
    if len(picked) > high:
        picked = sorted(picked, key=lambda i: -score[i])[:high]
    return sorted(picked)


@pytest.mark.parametrize("low, high", [(4, 8), (1, 3), (10, 12), (50, 60), (9, 5)])
def test_balanced_against_a_model(assets, low, high):
    rng = random.Random(low)
    rows = [(f"{i:02}", None if rng.random() < 0.15 else f"2024-{rng.randrange(1, 6):02}-{rng.randrange(1, 28):02}T00:00:00", rng.choice([None, 0.2, 0.5, 0.5, 0.9])) for i in range(30)]
    df = asset_frame(assets(*[{"asset_id": i, "captured_at": t, "score": s} for i, t, s in rows]))
    assert ids(select.balanced(df, low, high)) == balanced_model(rows, low, high)


def test_avoid_repeat(assets, spark):
    df = asset_frame(assets(*[{"asset_id": x} for x in "abcde"]))
    hist = spark.createDataFrame([("c", "2024-06-14"), ("d", "2024-06-13"), ("e", "2024-06-12")], "asset_id string, last_shown string").select("asset_id", F.to_date("last_shown").alias("last_shown"))
    got = {r["asset_id"]: r["fallback_backfilled"] for r in select.avoid_repeat(df, "2024-06-15", 7, 4, hist).collect()}
    assert got == {"a": False, "b": False, "e": True, "d": True}
    assert ids(select.avoid_repeat(df, "2024-06-15", 7, 1, hist)) == ["a", "b"]
    assert ids(select.avoid_repeat(df, "2024-06-15", 1, 1, hist)) == list("abcde")
    assert ids(select.avoid_repeat(df, "2024-06-15", 0, 1, hist)) == list("abcde")


MMR = [("sim1", 0.8, [1.0, 0.0, 0.0]), ("sim2", 0.79, [0.99, 0.01, 0.0]), ("diff", 0.7, [0.0, 0.0, 1.0])]


@pytest.mark.parametrize("rounds", [8, 0])
@pytest.mark.parametrize(
    "rows, params, want",
    [
        (MMR, {"max_picks": 2, "pick_percentage": 1.0, "quality_weight": 0.1, "diversity_weight": 0.9}, ["sim1", "diff"]),
        ([("a", 0.9, None), ("b", 0.7, None), ("c", 0.8, None)], {"max_picks": 2, "pick_percentage": 1.0}, ["a", "c"]),
        ([("zzz", 0.8, None), ("aaa", 0.8, None)], {"max_picks": 1}, ["aaa"]),
        ([(str(i), 0.5, None) for i in range(5)], {"max_picks": 2, "pick_percentage": 0.5}, ["0", "1"]),
        ([("a", 0.1, [float("nan"), 0.0]), ("b", None, [0.0, 0.0]), ("c", 0.2, [])], {"max_picks": 3, "pick_percentage": 1.0}, ["c", "a", "b"]),
        ([("a", 0.9, [1.0, 0.0]), ("b", 0.8, [0.6, 0.8]), ("z", 0.1, [0.0, 0.0])], {"max_picks": 2, "pick_percentage": 1.0}, ["a", "b"]),
    ],
)
def test_diverse_pick(assets, monkeypatch, rounds, rows, params, want):
    monkeypatch.setattr(select, "ROUNDS_MOST", rounds)
    df = asset_frame(assets(*[{"asset_id": i, "score": s, "embedding": v} for i, s, v in rows]))
    got = select.diverse_pick(df, **params).orderBy("ord").collect()
    assert [r["asset_id"] for r in got] == want and [r["group_best"] for r in got] == [True] + [False] * (len(want) - 1)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", "2024-01-01T10:00:00", H(0)), ("b", "2024-01-01T20:00:00", H(0))], ["a"]),
        ([("a", "2024-01-01T00:00:00", H(0)), ("b", "2024-01-02T00:00:00", H(0))], ["a", "b"]),
        ([("a", "2024-01-01T23:58:00", H(0)), ("b", "2024-01-02T00:02:00", H(1))], ["a"]),
        ([("a", "2024-01-01T12:00:00", H(0)), ("b", "2024-01-02T12:00:00", H(0))], ["a", "b"]),
        ([("a", None, H(0)), ("b", None, H(0)), ("c", "2024-01-01T12:00:00", None)], ["a", "b", "c"]),
    ],
)
def test_day_duplicates(assets, rows, want):
    df = asset_frame(assets(*[{"asset_id": i, "captured_at": t, "phash": h, "score": 0.5} for i, t, h in rows]))
    assert ids(select.drop_hash_duplicates(df)) == want


def test_duplicates_keep_the_best(assets):
    df = asset_frame(assets(*[{"asset_id": i, "phash": H(h), "score": s} for i, h, s in (("a", 0, 0.2), ("b", 1, 0.9), ("c", 0, 0.9), ("d", 2**60 - 1, 0.1))]))
    got = {r["asset_id"]: r["group_id"] for r in select.drop_hash_duplicates(df).collect()}
    assert got == {"b": "phash:0", "d": None}
