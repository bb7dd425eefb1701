from datetime import date

import pytest
from conftest import at
from pyspark.sql import functions as F

from photosluice.operators import filters
from photosluice.operators.frames import asset_frame
from photosluice.sources import cache, library


def ids(df):
    return sorted(r["asset_id"] for r in df.select("asset_id").collect())


def test_year_is_half_open(assets):
    df = assets(
        {"asset_id": "a", "captured_at": "2020-01-01T00:00:00"},
        {"asset_id": "b", "captured_at": "2020-12-31T23:59:59"},
        {"asset_id": "c", "captured_at": "2021-01-01T00:00:00"},
        {"asset_id": "d", "captured_at": None},
    )
    assert ids(library.by_year(df, 2020)) == ["a", "b"]


def test_recent_windows():
    run = date(2024, 6, 15)
    assert library.recent_window(run, days=7)[0] == date(2024, 6, 8)
    assert library.recent_window(run, weeks=2)[0] == date(2024, 6, 1)
    assert library.recent_window(run, months=1)[0] == date(2024, 5, 16)
    for bad in ({}, {"days": 1, "weeks": 1}, {"days": 0}):
        with pytest.raises(ValueError):
            library.recent_window(run, **bad)


@pytest.mark.parametrize("bad", [{"type": "moon"}, {"type": "year"}, {"type": "date_range", "from": "2020-01-01"}, {"type": "recent", "days": 3}, {"type": "album", "album_id": "x"}])
def test_source_errors(assets, bad):
    with pytest.raises(ValueError):
        library.build_source(assets(), **bad)


def test_album_and_range(assets, spark):
    df = assets({"asset_id": "a", "captured_at": "2020-03-02T00:00:00"}, {"asset_id": "b", "captured_at": "2020-03-03T00:00:00"})
    members = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b")], "album_id string, asset_id string")
    assert ids(library.build_source(df, "album", members=members, album_id="x")) == ["a"]
    assert ids(library.build_source(df, "date_range", **{"from": "2020-03-01", "to": "2020-03-02"})) == ["a"]


def test_filter_is_pushed_to_the_scan(spark):
    df = library.by_year(spark.read.parquet("/root/testdata/sf0.001/assets.parquet"), 2020).select("asset_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(captured_at" in plan and "embedding" not in plan


def test_frame_counts_an_asset_once(assets):
    df = assets({"asset_id": "a"}, {"asset_id": "a"}, {"asset_id": None})
    assert ids(asset_frame(df)) == ["a"]


def test_row_filters(assets):
    df = asset_frame(
        assets(
            {"asset_id": "a", "mime_type": "IMAGE/JPEG", "score": 0.5},
            {"asset_id": "b", "mime_type": "video/mp4", "score": 0.9},
            {"asset_id": "c", "mime_type": None, "score": None},
            {"asset_id": "d", "mime_type": "image/png", "score": float("nan"), "is_screenshot": True},
            {"asset_id": "e", "mime_type": "image/png", "score": 0.49, "is_screenshot": None},
        )
    )
    assert ids(filters.non_images(df)) == ["a", "d", "e"]
    assert ids(filters.min_score(df, 0.5)) == ["a", "b"]
    assert ids(filters.min_score(df, 0.0)) == ["a", "b", "c", "d", "e"]
    assert ids(filters.screenshots(df)) == ["a", "b", "c", "e"]


def test_limits_and_samples(assets):
    df = asset_frame(assets(*[{"asset_id": f"{i:02}", "captured_at": f"2024-01-01T00:00:{i:02}"} for i in range(20)]))
    assert ids(filters.first_n(df, 3)) == ["00", "01", "02"]
    one, two = ids(filters.random_sample(df, 5, 1)), ids(filters.random_sample(df, 5, 1))
    assert one == two and len(one) == 5
    assert ids(filters.random_sample(df, 5, 2)) != one
    assert len(ids(filters.random_sample(df, 50))) == 20


def test_empty_pool(assets):
    pool = asset_frame(assets(*[{"asset_id": f"{i:02}"} for i in range(10)]))
    none = pool.where("false")
    assert len(ids(filters.empty_pool(pool, pool, 5))) == 5
    assert ids(filters.empty_pool(none, pool, 5)) == []
    assert len(ids(filters.empty_pool(none, pool, 5, "fallback_random"))) == 5
    assert len(ids(filters.empty_pool(pool.limit(2), pool, 5, "fallback_random"))) == 2
    with pytest.raises(filters.EmptyPoolError):
        filters.empty_pool(none, pool, 5, "fail")
    with pytest.raises(ValueError):
        filters.empty_pool(none, pool, 5, "panic")


def test_day_of_any_year(assets):
    df = asset_frame(assets({"asset_id": "a", "captured_at": "2019-06-15T23:00:00"}, {"asset_id": "b", "captured_at": "2019-06-16T00:00:00"}, {"asset_id": "c", "captured_at": None}))
    assert ids(filters.on_this_day(df, "2024-06-15")) == ["a"]


def test_search_keeps_the_order_of_hits(assets, spark):
    df = asset_frame(assets(*[{"asset_id": x} for x in "abcd"]))
    hits = spark.createDataFrame([("c", 0), ("x", 1), ("a", 2), ("b", 3)], "asset_id string, rank int")
    rows = filters.smart_search(df, hits, 3, 10).orderBy("ord").collect()
    assert [r["asset_id"] for r in rows] == ["c", "a"]


def test_sensitive_signals(assets, spark):
    df = asset_frame(assets(*[{"asset_id": x} for x in "abcdef"]))
    tags = F.when(F.col("asset_id") == "c", F.array(F.lit("x"))).when(F.col("asset_id") == "f", F.array(F.lit(None).cast("string")))
    flags = F.when(F.col("asset_id") == "d", F.create_map(F.lit("k"), F.lit(0.7))).when(F.col("asset_id") != "e", F.create_map(F.lit("k"), F.lit(None).cast("double")))
    df = df.withColumns({"tags": tags, "vision_flags": flags, "vision_error": F.lit("no answer")})
    hits = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("a", "q2")], "asset_id string, query string")
    marked = filters.sensitive_signals(df, ["b"], ["x"], hits, 0.7, True)
    found = {r["asset_id"]: r["signals"] for r in marked.collect()}
    assert found == {"a": ["negative_query"] * 2, "b": ["blocklist"], "c": ["tag"], "d": ["vision"], "e": ["fail_closed"], "f": []}
    assert {r["signal"]: r["n"] for r in filters.sensitive_tally(marked).collect()}["negative_query"] == 2
    assert ids(filters.sensitive(df)) == list("abcdef")


def test_cache_last_write_wins(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"key": "a", "value": "1"}\nbroken\n{"key": "b", "value": "2"}\n{"key": "a", "value": "3"}\n')
    got = {r["key"]: r["value"] for r in cache.read_json_cache(spark, str(f), "string").collect()}
    assert got == {"a": "3", "b": "2"}
    key = spark.range(1).select(cache.tuple_key(F.lit("a:b"), F.lit("c")).alias("k")).first()["k"]
    assert key == '["a:b","c"]'


def test_latest_history(spark):
    rows = [("a", "2024-01-01", at("2024-03-01T00:00:00")), ("a", "2024-02-01", at("2024-02-01T00:00:00")), ("b", None, at("2024-02-01T00:00:00")), (None, "2024-01-01", at("2024-03-01T00:00:00"))]
    df = spark.createDataFrame(rows, "asset_id string, last_shown string, recorded_at timestamp")
    assert {r["asset_id"]: r["last_shown"] for r in cache.latest(df, "asset_id", "recorded_at", "last_shown").collect()} == {"a": "2024-01-01", "b": None}
