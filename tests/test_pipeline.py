from datetime import UTC, date, datetime

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from photosluice.functions.control import fill_template, next_run, parse_cron, undefined_variables
from photosluice.functions.scalars import asset_file_name, grid_key, parse_day, place_label, safe_name
from photosluice.operators import enrich, filters, flow, publish
from photosluice.operators.frames import asset_frame
from photosluice.operators.partition import evenly
from photosluice.plans import spec
from photosluice.plans.stages import Environment, named_pipeline, run_pipeline, validate_user_steps


def ids(df):
    return sorted(r["asset_id"] for r in df.select("asset_id").collect())


# written pipelines


def test_steps_in_every_form():
    p = spec.parse_pipeline('["select.best", ["filter.min_score", {"threshold": 0.5}, "keep"], {"stage": "select.best"}, null]')
    assert [(s.stage, s.alias) for s in p] == [("select.best", "best"), ("filter.min_score", "keep"), ("select.best", "best_2")]
    forms = [{"a": ["select.best"]}, [["a", ["select.best"]]], [{"name": "a", "pipeline": ["select.best"]}]]
    assert len({str(spec.parse_step(["fork", {"branches": b}]).branches) for b in forms}) == 1
    assert spec.parse_step(["fork", {"branches": [["select.best", "merge.concat"]]}]).branches[0][0] == "branch_0"
    for bad in (5, [], {"config": {}}, ["fork", {}], [5], ["select.best", 3]):
        with pytest.raises(ValueError):
            spec.parse_step(bad)


def test_settings_are_checked_before_anything_runs():
    ok = spec.checked_config("filter.min_score", {"threshold": "0.5"})
    assert ok == {"threshold": 0.5}
    assert spec.checked_config("partition.evenly", {})["number_of_partitions"] == 4
    for name, config in (
        ("filter.min_score", {"threshold": 2}), ("filter.min_score", {"limit": 1}), ("retrieve.by_year", {}), ("partition.time", {"time_window_minutes": 0}),
        ("filter.on_this_day", {"run_date": "2024-01-01", "on_empty_pool": "x"}), ("publish.create_album", {"name": "a", "dry_run": "maybe"}), ("retrieve.by_year", {"year": 2020.5}),
    ):
        with pytest.raises(ValueError):
            spec.checked_config(name, config)
    with pytest.raises(KeyError):
        spec.validate(spec.parse_pipeline(["no.such"]))


def test_registry():
    assert spec.has_stage("partition.scene") and not spec.has_stage("x") and len(spec.list_stages()) == 38
    with pytest.raises(ValueError):
        spec.stage("select.best")(lambda df, env: df)


def test_composite_settings():
    d = spec.get_stage("dedup.similar")
    assert d.param("threshold") and d.param("gps_window_meters") and d.param("time_window_minutes")
    assert [c[0] for c in d.children][-2:] == ["merge.concat", "merge.concat"]


def test_overrides():
    p = named_pipeline("best-of-year", {"by_year": {"year": 2020}, "output.branches.curation.scenes": {"max_picks": 5}, "output": {"branches": {"remainder": {"create_album": {"name": "R"}}}}})
    branches = dict(next(s for s in p if s.alias == "output").branches)
    assert next(s for s in branches["curation"] if s.alias == "scenes").config["max_picks"] == 5
    assert branches["remainder"][0].config["name"] == "R"
    for bad in ({"nobody": {}}, {"output.branches.none.x": {}}, {"output.branches.curation": {}}):
        with pytest.raises(KeyError):
            named_pipeline("best-of-year", {"by_year": {"year": 2020}} | bad)
    with pytest.raises(ValueError):
        named_pipeline("best-of-year")
    shown = spec.describe(p)
    assert shown[0]["params"][0]["key"] == "year" and "curation" in shown[-1]["branches"]


def test_user_steps_are_validated():
    assert validate_user_steps([["filter.min_score", {"threshold": 0.1}]]) == []
    assert "no.such" in validate_user_steps(["no.such"])[0]
    assert validate_user_steps([["fork", {"branches": {}}]])


def test_small_pipeline(assets):
    a = assets({"asset_id": "img1", "score": 0.5}, {"asset_id": "vid1", "score": 0.9, "mime_type": "video/mp4"}, {"asset_id": "img2", "score": 0.8, "mime_type": "image/png"})
    assert ids(run_pipeline([["source", {}], "filter.non_images", "select.best"], Environment(assets=a))) == ["img2"]
    fork = [["source", {}], ["fork", {"branches": {"images": ["filter.non_images", "select.best"], "all": ["select.best"]}}]]
    got = run_pipeline(fork, Environment(assets=a)).select("branch", "asset_id").collect()
    assert sorted(map(tuple, got)) == [("all", "vid1"), ("images", "img2")]


def test_cascade_and_merge(assets):
    df = asset_frame(assets(*[{"asset_id": x, "score": s} for x, s in zip("abcd", (0.9, 0.8, 0.3, 0.1))]))
    out = flow.fork_by_selection(df, {"top": lambda d: filters.min_score(d, 0.8), "mid": lambda d: filters.min_score(d, 0.2), "rest": lambda d: d})
    assert sorted((r["branch"], r["asset_id"]) for r in out.collect()) == [("mid", "c"), ("rest", "d"), ("top", "a"), ("top", "b")]
    with pytest.raises(ValueError):
        flow.fork(df, {})


def test_stats_merge(spark):
    rows = [("p", "0", "count", "number", "2"), ("p", "1", "count", "number", "3"), ("p", "0", "items", "list", '["x"]'), ("p", "1", "items", "list", '["y"]'), ("p", "1", "extra", "boolean", "true"), ("p", "0", "extra", "boolean", "false"), ("p", "0", "t", "text", "a"), ("p", "1", "t", "text", "b")]
    got = {r["key"]: r["value"] for r in flow.merge_stats(spark.createDataFrame(rows, "parent string, child string, key string, kind string, value string")).collect()}
    assert got == {"count": "5", "items": '["x","y"]', "extra": "true", "t": "a"}


# sinks


def test_albums(assets, spark):
    df = asset_frame(assets({"asset_id": "a"}, {"asset_id": "b"}))
    albums = spark.createDataFrame([("1", "Old")], "album_id string, name string")
    out, rows = publish.create_album(df, albums, "New")
    assert out["created"] and ids(rows) == ["a", "b"]
    assert publish.create_album(df, albums, "Old")[0]["conflict"] and publish.create_album(df, albums, "Old")[1].count() == 0
    assert publish.create_album(df, albums, "New", dry_run=True)[0]["would_create"] == 2
    current = spark.createDataFrame([("b",), ("c",)], "asset_id string")
    out, changes = publish.replace_album(df, current, "Old")
    assert {r["asset_id"]: r["action"] for r in changes.collect()} == {"a": "add", "b": "keep", "c": "remove"}
    assert (out["added"], out["removed"], out["final_count"]) == (1, 1, 2)
    assert publish.replace_album(df.where("false"), current, "Old")[0]["refused_empty"]
    assert publish.replace_album(df.where("false"), current, "Old", allow_empty=True)[0]["removed"] == 2


def test_export(assets, spark, tmp_path):
    df = evenly(asset_frame(assets({"asset_id": "../a b", "embedding": [1.0, 2.0]}, {"asset_id": "b", "mime_type": "image/PNG"})), 2)
    rows = sorted(publish.export_rows(df).collect(), key=lambda r: r["file_name"])
    assert [r["file_name"] for r in rows] == ["a_b.jpg", "b.png"] or [r["file_name"] for r in rows] == ["_a_b.jpg", "b.png"]
    assert "<omitted: 2-dim vector>" in rows[0]["record"] and [r["position"] for r in rows] == [0, 0]
    path = publish.export_contexts(df, str(tmp_path))
    assert spark.read.json(path).count() == 2
    assert "[1.0,2.0]" in publish.export_rows(df, include_embeddings=True).collect()[0]["record"] + publish.export_rows(df, include_embeddings=True).collect()[1]["record"]


def test_replace_album_stage_writes_nothing_in_a_dry_run(assets, spark):
    env = Environment(assets=assets({"asset_id": "a"}), albums=spark.createDataFrame([("1", "F")], "album_id string, name string"), members=spark.createDataFrame([("1", "z")], "album_id string, asset_id string"))
    run_pipeline([["source", {}], ["publish.replace_album", {"name": "F", "dry_run": True}]], env)
    assert env.outcomes[0]["would_add"] == 1 and env.outcomes[0]["would_remove"] == 1 and not env.writes
    run_pipeline([["source", {}], ["publish.replace_album", {"name": "F", "run_date": "2024-01-01"}]], env)
    assert [w[0] for w in env.writes] == ["changes", "history"]


# enrichment


def test_scores_are_remembered(assets, spark):
    df = asset_frame(assets(*[{"asset_id": x} for x in "abcdef"]))
    answers = {"a": {"score": 8.5}, "b": {"score": "not-a-number"}, "c": [1], "d": {"error": "no"}, "e": {"score": 0.25, "is_screenshot": "false"}}
    cached = spark.createDataFrame([("f:" + enrich.short_digest("p"), '{"score": 0.75}')], "key string, value string")
    out, new = enrich.analyze_score(df, "p", lambda batch: [answers[x] for x in batch], cached)
    got = {r["asset_id"]: (r["score"], r["error"]) for r in out.collect()}
    assert got["a"] == (1.0, None) and got["e"] == (0.25, None) and got["f"] == (0.75, None)
    assert got["b"][0] is None and got["b"][1] and got["c"][1] and got["d"] == (0.0, "no")
    assert {r["key"].split(":")[0] for r in new.collect()} == {"a", "e"}
    assert enrich.score_result({"score": 2, "is_screenshot": "true"}) == (1.0, True, None)
    assert enrich.score_result({"score": float("nan")})[2] and enrich.score_result([])[2]


def test_failing_providers(assets):
    df = asset_frame(assets({"asset_id": "a", "score": 0.4}))

    def broken(batch):
        raise RuntimeError("down")

    out, new = enrich.analyze_score(df, "p", broken)
    r = out.first()
    assert r["score"] == 0.4 and "down" in r["error"] and new.count() == 0
    hashed, _ = enrich.analyze_phash(df, broken)
    assert hashed.first()["phash"] == ""


def test_vectors_reach_every_copy(assets):
    df = asset_frame(assets({"asset_id": "a"}, {"asset_id": "a"}, {"asset_id": "b", "embedding": [9.0]}), distinct=False)
    out, new = enrich.analyze_embedding(df, lambda batch: [[1.0, 2.0] for _ in batch])
    assert sorted(tuple(r["embedding"]) for r in out.collect()) == [(1.0, 2.0), (1.0, 2.0), (9.0,)] and new.count() == 1
    assert enrich.analyze_embedding(df, None)[0] is df


def test_places(assets, spark):
    places = spark.createDataFrame([("Pier", "Kiel", None, "DE", 54.32, 10.14), ("Mole", None, "SH", "DE", 54.321, 10.141), ("Far", "X", None, "Y", 10.0, 10.0), ("Wrap", "W", None, "Z", 0.0, -179.9995)], "name string, city string, state string, country string, latitude double, longitude double")
    df = asset_frame(assets({"asset_id": "a", "latitude": 54.3201, "longitude": 10.1401}, {"asset_id": "b"}, {"asset_id": "c", "latitude": 0.0, "longitude": 0.0}, {"asset_id": "d", "latitude": float("nan"), "longitude": 1.0}, {"asset_id": "e", "latitude": 0.0, "longitude": 179.9995}))
    got = {r["asset_id"]: r["geo"] for r in enrich.enrich_geolocation(df, places).collect()}
    assert [c["name"] for c in got["a"]["candidates"]] == ["Pier", "Mole"] and got["a"]["label"] == "Pier, Kiel"
    assert got["b"] is None and got["c"] is None and got["d"] is None and got["e"]["label"] == "Wrap, W"
    one = {r["asset_id"]: r["geo"] for r in enrich.enrich_geolocation(df, places, max_candidates=1).collect()}
    assert len(one["a"]["candidates"]) == 1


def test_image_kernels(spark):
    flat, ramp = bytes([7] * 1024), bytes(int(x) for x in np.tile(np.arange(32) * 8, 32))
    noisy = bytes(np.random.default_rng(0).integers(0, 256, 1024, dtype=np.uint8))
    df = spark.createDataFrame([("f", flat), ("r", ramp), ("n", noisy), ("x", b"1"), ("y", None)], "asset_id string, pixels binary")
    got = {r["asset_id"]: r for r in enrich.with_image_kernels(df).collect()}
    assert got["x"]["phash"] == got["y"]["phash"] == "" and got["f"]["sharpness"] == 0.0 and got["n"]["sharpness"] > 0.9
    assert len(got["r"]["phash"]) == 16 and got["r"]["phash"] != got["n"]["phash"]
    shifted = np.clip(np.frombuffer(noisy, np.uint8).astype(int) // 2 + 40, 0, 255).astype(np.uint8).reshape(32, 32)
    a, b = int(got["n"]["phash"], 16), int(enrich.perceptual_hash(shifted), 16)
    assert bin(a ^ b).count("1") <= 3


# pure functions


def test_cron():
    t = datetime(2024, 6, 15, 12, 0, tzinfo=UTC)
    assert next_run("0 4 * * *", t) == datetime(2024, 6, 16, 4, 0, tzinfo=UTC)
    assert next_run("0 0 * * 7", t) == datetime(2024, 6, 16, 0, 0, tzinfo=UTC)
    assert next_run("0 0 13 * 1", t) == datetime(2024, 6, 17, 0, 0, tzinfo=UTC)
    assert next_run("0 0 29 2 *", t) == datetime(2028, 2, 29, 0, 0, tzinfo=UTC)
    assert next_run("0 0 31 2 *", t) is None
    assert next_run("*/20 12 * * *", t) == datetime(2024, 6, 15, 12, 20, tzinfo=UTC)
    assert parse_cron("5/1 * * * *")[0] == {5} and parse_cron("50/5 * * * *")[0] == {50, 55}
    for bad in ("* * * *", "60 * * * *", "* * 0 * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            parse_cron(bad)


def test_templates():
    value = {"name": "Best of {YEAR}", "list": ["{A}", 3, {"x": "{B}"}]}
    assert fill_template(value, {"YEAR": 2020, "A": "a"}) == {"name": "Best of 2020", "list": ["a", 3, {"x": "{B}"}]}
    assert undefined_variables(value, {"YEAR": 1}) == ["A", "B"]


def test_scalars(spark):
    r = spark.range(1).select(
        safe_name(F.lit("..a/b c.")).alias("n"), safe_name(F.lit("__")).alias("d"), asset_file_name(F.lit("x"), F.lit("IMAGE/HEIC")).alias("f"),
        grid_key(F.lit(2.5), F.lit(-0.12345), 0, 1000).alias("k"), parse_day(F.lit("2024-02-30")).alias("bad"), parse_day(F.lit("2024-02-03T10:00:00Z")).alias("day"),
        place_label(F.lit(" "), F.lit(None), F.lit("S"), F.lit("C")).alias("l"), place_label(F.lit(None), F.lit(""), F.lit(None), F.lit(None)).alias("none"),
    ).first()
    assert r["n"] == "a_b_c" and r["f"] == "x.heic" and r["k"].startswith("2.0:0.0:") and r["bad"] is None and r["day"] == date(2024, 2, 3)
    assert r["l"] == "S, C" and r["none"] is None and r["d"]


# streams


def test_streams(spark, tmp_path):
    from photosluice.streaming.upserts import burst_sessions, keep_history, read_history

    src = str(tmp_path / "in")
    schema = "asset_id string, last_shown string, recorded_at timestamp, captured_at timestamp"
    rows = [("a", "2024-01-01", at("2024-01-01T00:00:00"), at("2024-01-01T10:00:00")), ("a", "2024-02-01", at("2024-03-01T00:00:00"), at("2024-01-01T10:03:00")), ("b", "2024-01-05", at("2024-01-05T00:00:00"), at("2024-01-01T12:00:00"))]
    spark.createDataFrame(rows, schema).write.parquet(src + "/0")
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    for _ in range(2):
        keep_history(stream.select("asset_id", "last_shown", "recorded_at"), str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    assert {r["asset_id"]: r["last_shown"] for r in read_history(spark, str(tmp_path / "h")).collect()} == {"a": "2024-02-01", "b": "2024-01-05"}
    with pytest.raises(ValueError):
        burst_sessions(stream)
    q = burst_sessions(stream.withColumn("camera", F.lit(1) + F.length("asset_id")), "camera").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    q.awaitTermination()
    assert [r["records"] for r in spark.table("bursts").collect()] == [2]


# configuration, progress, connector


def test_configurations(tmp_path):
    from photosluice.plans.config import load_config, pipeline_of

    f = tmp_path / "c.json"
    f.write_text('{"pipeline": "best-of-year", "pipeline_settings": {"by_year": {"year": "{YEAR}"}}, "variables": {"YEAR": 2021}}')
    p = pipeline_of(load_config(str(f)))
    assert p[0].config == {"year": 2021}
    assert dict(p[-1].branches)["curation"][-1].config["name"] == "Best of 2021"
    with pytest.raises(ValueError):
        pipeline_of({"pipeline": "best-of-year", "pipeline_settings": {"by_year": {"year": 2020}}})
    with pytest.raises(ValueError):
        pipeline_of({})
    f.write_text("")
    assert load_config(str(f)) == {} and load_config(None, str(tmp_path / "none.json")) == {}
    f.write_text("[1]")
    with pytest.raises(ValueError):
        load_config(str(f))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "gone.json"))


def test_progress_is_throttled():
    import io

    from photosluice.plans.config import JsonProgress, NoProgress, read_progress

    out, now = io.StringIO(), [0.0]
    p = JsonProgress(out, lambda: now[0])
    p.begin("select.best", 1000)
    for i in range(1, 101):
        p.advance(i)
    now[0] = 1.5
    p.advance(101)
    p.end(selected=3)
    said = [read_progress(x) for x in out.getvalue().splitlines()]
    assert [x["completed"] for x in said if x["type"] == "advance"] == [1, 21, 41, 61, 81, 101] and said[-1]["selected"] == 3
    assert read_progress("plain") is None and read_progress("@@PROGRESS@@{") is None
    NoProgress().advance(1)


def test_counts_come_with_the_result(assets):
    env = Environment(assets=assets(*[{"asset_id": str(i), "score": i / 10} for i in range(10)]), observations=[])
    assert run_pipeline([["source", {}], ["filter.min_score", {"threshold": 0.5}], ["filter.none", {"photo_count": 3}]], env).count() == 3
    assert env.record_counts() == [("source", "source", 10), ("min_score", "filter.min_score", 5), ("none", "filter.none", 3)]


def test_connector_reads_pages_in_parallel(spark):
    from photosluice.sources.connector import read_library

    def client():
        from datetime import UTC, datetime, timedelta

        class Library:
            def search(self, start, stop, page, size):
                first = datetime(2024, 1, 1, tzinfo=UTC)
                every = [first + timedelta(hours=i) for i in range(100)]
                found = [{"asset_id": t.isoformat(), "captured_at": t} for t in every if start <= t < stop]
                return found[page * size : (page + 1) * size]

        return Library()

    df = read_library(spark, client, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 4, tzinfo=UTC), ranges=5, page_size=7)
    assert df.count() == df.select("asset_id").distinct().count() == 72 and df.rdd.getNumPartitions() == 5
    assert ids(run_pipeline([["source", {"type": "date_range", "from": "2024-01-02", "to": "2024-01-02"}]], Environment(assets=df)))[0].startswith("2024-01-02T00")
