import json

from pyspark.sql import functions as F

from photosluice.operators.logs import log_entries, resolved_shapes, shape_of
from photosluice.operators.nested import child_table, merged_schema, pipeline_steps, tree_nodes

STEPS = [
    "select.best",
    ["filter.min_score", {"threshold": 0.5}],
    None,
    {"stage": "fork", "alias": "f", "config": {"branches": {"été": [["fork.by_selection", {"branches": [["a", ["x", None, "y"]], {"name": "b", "pipeline": [{"stage": "z"}]}, ["p", ["q"]]]}, None]], "empty": []}}},
    ["fork", {"note": "none"}],
    ["fork", None],
    ["other", {"branches": {"no": ["step"]}}],
    {"alias": "nameless"},
]


def steps_of(spark, *texts):
    df = spark.createDataFrame([(f"r{i}", t, "x") for i, t in enumerate(texts)], "id string, steps string, path string")
    return {(r["id"], r["node_path"], r["parent_path"]): r for r in pipeline_steps(df, "steps", "id").collect()}


def test_steps_at_any_depth(spark):
    text = json.dumps(STEPS)
    got = steps_of(spark, text, json.dumps(text), json.dumps(json.dumps(text)), text[:-3], "", None, '"hello"', "[]", '{"a": 1}', "null", "12")
    want = {
        ("0", ""), ("1", ""), ("3", ""), ("3/été/0", "3"), ("3/été/0/a/0", "3/été/0"), ("3/été/0/a/2", "3/été/0"), ("3/été/0/b/0", "3/été/0"),
        ("3/été/0/p/0", "3/été/0"), ("4", ""), ("5", ""), ("6", ""), ("7", ""),
    }
    for i in range(3):
        assert {(p, q) for r, p, q in got if r == f"r{i}"} == want
    assert {r for r, _, _ in got} == {"r0", "r1", "r2"}
    row = got[("r0", "3/été/0/b/0", "3/été/0")]
    assert (row["stage"], row["branch"], row["ordinal"]) == ("z", "b", 0)
    assert row["parent_id"] == got[("r0", "3/été/0", "3")]["node_id"] and got[("r0", "3", "")]["alias"] == "f"
    assert got[("r0", "7", "")]["stage"] is None


def test_repeated_and_no_records(spark):
    df = spark.createDataFrame([("a", '["x"]'), ("a", '["x"]')], "id string, steps string")
    assert pipeline_steps(df, "steps", "id").count() == 1
    assert pipeline_steps(df.limit(0), "steps", "id").count() == 0
    assert tree_nodes(df.limit(0), "steps", "id").count() == 0


def test_tree_of_values(spark):
    value = {"a": {"b": [1, 2.5, None, {"c": "x/y"}], "e": {}, "l": []}, "t": True, "big": 12345678901234567890, "u": "ü"}
    df = spark.createDataFrame([("1", json.dumps(value)), ("2", '{"a": {"b": ["s"]}}'), ("3", '{"a":'), ("4", None)], "id string, v string")
    nodes = tree_nodes(df, "v", "id")
    rows = {(r["id"], r["path"]): r for r in nodes.collect()}
    scalars = {p: r["value"] for (i, p), r in rows.items() if i == "1" and r["kind"] not in ("object", "array")}
    assert scalars == {"a/b/0": "1", "a/b/1": "2.5", "a/b/2": None, "a/b/3/c": "x/y", "t": "true", "big": "12345678901234567890", "u": "ü"}
    assert rows[("1", "a/b/3")]["parent_id"] == rows[("1", "a/b")]["node_id"] and rows[("1", "a/b/3")]["ordinal"] == 3
    assert {i for i, _ in rows} == {"1", "2"}
    schema = {r["place"]: r["kinds"] for r in merged_schema(nodes).collect()}
    assert "string" in schema["a/b/[]"] and "object" in schema["a/b/[]"] and schema["a/e"] == ["object"]
    table = child_table(nodes, "a/b/[]", ["c"])
    own = table.where(F.col("parent_id") == rows[("1", "a/b")]["node_id"]).collect()
    assert sorted((r["ordinal"], r["value"], r["field_c"]) for r in own) == [(0, "1", None), (1, "2.5", None), (2, None, None), (3, None, "x/y")]


def test_names_with_separators_keep_their_links(spark):
    value = {"a": {"b": {"x": 1}}, "a/b": {"x": 2}, "[]": [{"~": 3}], "~1": 4, "": {"": 5}}
    df = spark.createDataFrame([("1", json.dumps(value))], "id string, v string")
    nodes = tree_nodes(df, "v", "id")
    rows = nodes.collect()
    assert len({r["node_id"] for r in rows}) == len(rows) == 11 and len({r["place"] for r in rows}) == 11
    by = {r["node_id"]: r for r in rows}
    up = {r["value"]: [r["name"], *([by[r["parent_id"]]["name"]] if r["parent_id"] in by else [])] for r in rows if r["value"]}
    assert up == {"1": ["x", "b"], "2": ["x", "a/b"], "3": ["~", None], "4": ["~1"], "5": ["", ""]}


def test_text_quoted_often(spark):
    text = '{"a": [1]}'
    for _ in range(8):
        text = json.dumps(text)
    df = spark.createDataFrame([("1", text), ("2", json.dumps("plain")), ("3", '"broken')], "id string, v string")
    assert [(r["id"], r["path"]) for r in tree_nodes(df, "v", "id").where("kind = 'bigint'").collect()] == [("1", "a/0")]


def test_child_tables_follow_the_merged_schema(spark):
    from photosluice.operators.nested import child_tables, fields_of

    first = {"who": "x", "steps": [{"n": 1, "deep": {"k": "v"}, "tags": ["t", "u"]}, {"n": 2}]}
    second = {"steps": [{"other": True, "tags": []}, "bare"], "lone": [[1], [2, 3]]}
    df = spark.createDataFrame([("1", json.dumps(first)), ("2", json.dumps(second))], "id string, v string")
    nodes = tree_nodes(df, "v", "id")
    assert fields_of(nodes) == {"": ["who"], "lone/[]": [], "lone/[]/[]": [], "steps/[]": ["deep/k", "n", "other"], "steps/[]/tags/[]": []}
    tables = child_tables(nodes)
    steps = {r["node_id"]: r for r in tables["steps/[]"].collect()}
    assert sorted((r["ordinal"], r["field_n"], r["field_deep/k"], r["field_other"], r["value"]) for r in steps.values() if r["field_n"]) == [(0, "1", "v", None, None), (1, "2", None, None, None)]
    tags = tables["steps/[]/tags/[]"].collect()
    assert sorted((r["ordinal"], r["value"], steps[r["parent_row"]]["field_n"]) for r in tags) == [(0, "t", "1"), (1, "u", "1")]
    assert tables["lone/[]/[]"].count() == 3


def test_very_deep_value(spark):
    text = "[" * 60 + "7" + "]" * 60
    df = spark.createDataFrame([("d", text)], "id string, v string")
    got = tree_nodes(df, "v", "id").where("kind = 'bigint'").collect()
    assert len(got) == 1 and got[0]["depth"] == 60 and got[0]["path"] == "/".join("0" * 60)


LINES = [
    ("2025-01-22 17:47:33,552 \x1b[32mINFO    \x1b[0m core.cache — hello", 1737568053552000, "INFO", "core.cache", "hello"),
    ("2025-01-22 17:47:33,552 CRITICAL core.cache - hello", 1737568053552000, "CRITICAL", "core.cache", "hello"),
    ('ts=2025-01-22T17:47:41Z level=crit component=pool msg="an \\"a\\" and \\\\ b"', 1737568061000000, "CRITICAL", "pool", 'an "a" and \\ b'),
    ('{"pid": 1, "level": "fatal", "message": "f\\u00fcr", "component": "s.r", "timestamp": "2025-01-22T17:47:55.746Z"}', 1737568075746000, "CRITICAL", "s.r", "für"),
    ('{"time": "2025-01-22T17:47:55.746Z", "lvl": "trace", "logger": "s", "msg": "m"}', 1737568075746000, "DEBUG", "s", "m"),
    ('{"@t": "2025-01-22T17:47:55+01:00", "severity": "warn", "source": "s", "text": ""}', 1737564475000000, "WARNING", "s", ""),
    ("2025-01-22T12:47:28.181093-05:00 [info] exif.reader: a | b: c", 1737568048181093, "INFO", "exif.reader", "a | b: c"),
    ("I20240721 07:55:57.450598  77605 io_reader.h:339] Kurve — 1", 1721548557450598, "INFO", "io_reader.h", "Kurve — 1"),
    ("[1721548566.529981] W/heif.decoder(639): m", 1721548566529981, "WARNING", "heif.decoder", "m"),
    ("01.05.2024 19:16:57.525 | NOTICE | frame writer | a | b", 1714591017525000, "INFO", "frame writer", "a | b"),
    ("2024/03/03 19:17:09 [notice] gateway#87: m", 1709493429000000, "INFO", "gateway", "m"),
    ("Sun Mar 03 19:16:48 2024 backup ERR: settings: {'min': 1}", 1709493408000000, "ERROR", "backup", "settings: {'min': 1}"),
    ("1716983279099 WARN (cron-loop) m", 1716983279099000, "WARNING", "cron-loop", "m"),
]
DECOYS = [
    "    2025-01-22 17:47:33,552 INFO     core.cache — quoted", "2024-03-03 was the last day seen", "[12:00:01] done so far", "ERROR was ignored",
    '{"level": "info", "kept": 3}', "{", "| 36 | 65 |", "2025-13-45 17:47:33,552 INFO     core.cache — no such day", "2025-01-22 17:47:33,552 LOUD     core.cache — no level", "1 days are missing",
]


def entries(spark, *texts):
    df = spark.createDataFrame([(f"j{i}", t, "y") for i, t in enumerate(texts)], "id string, log string, level string")
    return sorted(log_entries(df, "log", "id").collect(), key=lambda r: (r["id"], r["first_line"]))


def test_every_layout(spark):
    got = entries(spark, "\r\n".join(line for line, *_ in LINES))
    assert [(r["ts_us"], r["level"], r["component"], r["message"]) for r in got] == [x[1:] for x in LINES]
    assert [r["message_chars"] for r in got] == [len(x[4]) for x in LINES] and [r["first_line"] for r in got] == list(range(1, len(LINES) + 1))


def test_continuations(spark):
    text = "\n".join(["head is gone", LINES[0][0], *DECOYS, "", '@@PROGRESS@@{"a": 1}', "  tail\x1b[0m\r", " ", "", '@@PROGRESS@@{"b": 1}', LINES[8][0], ""])
    a, b = entries(spark, text)
    body = ["hello", *DECOYS, "", "  tail"]
    assert (a["first_line"], a["last_line"]) == (2, 2 + len(DECOYS) + 3)
    assert a["message"] == "\n".join(body) and a["message_chars"] == len(a["message"])
    assert b["first_line"] == b["last_line"] == a["last_line"] + 4


def test_logs_without_entries(spark):
    assert entries(spark, None, "", "nothing\nhere", "\n\n", '@@PROGRESS@@{"a": 1}') == []
    df = spark.createDataFrame([("a", LINES[0][0]), ("a", LINES[0][0])], "id string, log string")
    assert log_entries(df, "log", "id").count() == 1 and log_entries(df.limit(0), "log", "id").count() == 0


def test_one_very_long_message(spark):
    line = LINES[0][0] + "x" * 300_000
    (r,) = entries(spark, line + "\n" + "y" * 200_000)
    assert r["message_chars"] == 5 + 300_000 + 1 + 200_000


def test_shapes_resolve_once(spark):
    df = spark.createDataFrame([(x[0],) for x in LINES] * 50, "line string").select(shape_of("line").alias("shape"))
    rules = resolved_shapes(df).collect()
    assert len(rules) <= 2 * len(LINES) and len({r["shape"] for r in rules}) == len(rules)
    assert df.where(F.length("shape") > 32).count() == 0


def test_programs_without_a_layout(spark):
    from photosluice.operators.logs import GENERAL, shape_report

    text = "\n".join([
        "2024-05-01T10:00:00Z INFO worker: started",
        "  more of it",
        "<165>1 2003-10-11T22:14:15.003Z host app 1234 ID47 - it broke",
        "W0102 15:04:05.123456 1234 file.cc:12] slow",
        "ERROR db.pool: lost",
        "2024-05-01 10:00:01,5 | web | warning | late",
        "Error while nothing",
        "2024-05-01T10:00:02Z INFO a\u0001b\u0001c: odd\u0001one",
    ])
    df = spark.createDataFrame([("1", text)], "id string, log string")
    assert log_entries(df, "log", "id").count() == 0
    got = [tuple(r) for r in log_entries(df, "log", "id", general=GENERAL).orderBy("first_line").select("first_line", "last_line", "level", "component", "message").collect()]
    assert got == [
        (1, 2, "INFO", "worker", "started\n  more of it"), (3, 3, "INFO", "app", "it broke"), (4, 4, "WARNING", "file.cc", "slow"), (5, 5, "ERROR", "db.pool", "lost"),
        (6, 7, "WARNING", "web", "late\nError while nothing"), (8, 8, "INFO", "a\u0001b\u0001c", "odd\u0001one"),
    ]
    counts = {r["layout"]: r["lines"] for r in shape_report(df, "log", "id").collect()}
    assert counts[None] == 2 and counts["time_level"] == 2 and sum(counts.values()) == 8
