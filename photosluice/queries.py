"""Queries of the engine's own operators over the test tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photosluice.functions.control import next_run
from photosluice.functions.scalars import bits_of_hash, grid_key, hamming, place, unit_score
from photosluice.operators import filters, flow, partition, publish, select
from photosluice.operators.frames import asset_frame, context_id, merge, split
from photosluice.operators.logs import log_entries, shape_report
from photosluice.operators.nested import child_table, child_tables, merged_schema, pipeline_steps, tree_nodes
from photosluice.operators.similarity import cosine_pairs, hamming_pairs
from photosluice.plans.stages import Environment, run_pipeline
from photosluice.sources import cache, library

RUN_DATE = date(2024, 6, 15)

# one row an asset; all deliveries of an asset are alike
ASSETS = """
WITH a AS (
  SELECT asset_id, max(filename) AS filename, max(captured_at) AS captured_at, max(mime_type) AS mime_type,
    max(latitude) AS latitude, max(longitude) AS longitude, max(file_size) AS file_size, max(album_id) AS album_id,
    max(score) AS score, bool_or(is_screenshot) AS is_screenshot, max(phash) AS phash,
    epoch_us(max(captured_at)) AS us, coalesce(epoch_us(max(captured_at)), 9223372036854775807) AS ord,
    CASE WHEN max(score) IS NULL OR isnan(max(score)) THEN 0 ELSE max(score) END AS raw,
    CASE WHEN max(score) IS NULL OR isnan(max(score)) THEN 0 ELSE least(1, greatest(0, max(score))) END AS s,
    (max(captured_at) AT TIME ZONE 'UTC') AS utc
  FROM assets WHERE asset_id IS NOT NULL GROUP BY asset_id)
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "assets").drop("ingested_at")


def _frame(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """All assets as one context; vectors only where they are used."""
    rows = _assets(spark, sf_dir)
    return asset_frame(rows if vectors else rows.drop("embedding"))


def _one_size(df: DataFrame) -> DataFrame:
    """Embeddings of another size than 64 resemble nothing: they become null, their records stay."""
    return df.withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding")))


def _by_album(frame: DataFrame) -> DataFrame:
    """One context an album, those of no album together."""
    return split(frame, F.coalesce("album_id", F.lit("none")), F.lit(0))


def _picked(df: DataFrame, *more) -> DataFrame:
    return df.select("asset_id", *more)


def _last_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.latest(_table(spark, sf_dir, "publish_history"), "asset_id", "recorded_at", "last_shown")


_SOURCE = "SELECT asset_id, us AS ts_us FROM a WHERE "


def _source(df: DataFrame) -> DataFrame:
    return asset_frame(df).select("asset_id", F.unix_micros("captured_at").alias("ts_us"))


@query(ASSETS + _SOURCE + "utc >= TIMESTAMP '2020-01-01' AND utc < TIMESTAMP '2021-01-01'")
def src_by_year(spark, d):
    return _source(library.by_year(_assets(spark, d), 2020))


@query(ASSETS + _SOURCE + "utc >= TIMESTAMP '1970-01-01' AND utc < TIMESTAMP '2101-01-01'")
def src_library(spark, d):
    return _source(library.library(_assets(spark, d)))


@query(ASSETS + _SOURCE + "utc >= TIMESTAMP '2019-03-01' AND utc < TIMESTAMP '2019-09-01'")
def src_date_range(spark, d):
    return _source(library.date_range(_assets(spark, d), "2019-03-01", "2019-08-31"))


@query(ASSETS + _SOURCE + "utc >= TIMESTAMP '2024-03-17' AND utc < TIMESTAMP '2024-06-16'")
def src_recent_days(spark, d):
    return _source(library.recent(_assets(spark, d), RUN_DATE, days=90))


@query(ASSETS + _SOURCE + "utc >= TIMESTAMP '2023-12-18' AND utc < TIMESTAMP '2024-06-16'")
def src_recent_months(spark, d):
    return _source(library.recent(_assets(spark, d), RUN_DATE, months=6))


@query(ASSETS + "SELECT asset_id FROM a WHERE album_id = 'alb-0000'")
def src_album(spark, d):
    assets = _assets(spark, d)
    return _picked(asset_frame(library.album(assets, assets.select("album_id", "asset_id"), "alb-0000")))


@query(ASSETS + "SELECT asset_id FROM a WHERE lower(mime_type) LIKE 'image/%'")
def flt_non_images(spark, d):
    return _picked(filters.non_images(_frame(spark, d)))


@query(ASSETS + "SELECT asset_id FROM a WHERE raw >= 0.6")
def flt_min_score(spark, d):
    return _picked(filters.min_score(_frame(spark, d), 0.6))


@query(ASSETS + "SELECT asset_id FROM a WHERE NOT coalesce(is_screenshot, false)")
def flt_screenshots(spark, d):
    return _picked(filters.screenshots(_frame(spark, d)))


@query(ASSETS + "SELECT asset_id FROM a ORDER BY ord, asset_id LIMIT 500")
def flt_first_n(spark, d):
    return _picked(filters.first_n(_frame(spark, d), 500))


@query(ASSETS + "SELECT asset_id FROM a ORDER BY md5('7:' || asset_id) LIMIT 500")
def flt_random(spark, d):
    return _picked(filters.random_sample(_frame(spark, d), 500, seed=7))


@query(ASSETS + "SELECT asset_id FROM a WHERE month(utc) = 6 AND day(utc) = 15")
def flt_on_this_day(spark, d):
    return _picked(filters.on_this_day(_frame(spark, d), RUN_DATE))


@query(ASSETS + "SELECT asset_id FROM a WHERE asset_id IN (SELECT asset_id FROM publish_history)")
def flt_people(spark, d):
    """Assets ever shown stand in for those with a known face."""
    return _picked(filters.people(_frame(spark, d), _table(spark, d, "publish_history").select("asset_id")))


@query(
    ASSETS + ", h AS (SELECT asset_id, row_number() OVER (ORDER BY coalesce(file_size, 0) DESC, asset_id) AS rank FROM a WHERE lower(filename) LIKE '%scan%') "
    "SELECT asset_id, rank - 1 AS place FROM h WHERE rank <= 200"
)
def flt_smart_search(spark, d):
    """Names with a word, larger files first, stand in for a search."""
    frame = _frame(spark, d)
    named = frame.where(F.lower("filename").contains("scan")).select("asset_id", (-F.coalesce("file_size", F.lit(0))).alias("size"))
    best = named.orderBy("size", "asset_id").limit(300)
    from pyspark.sql import Window

    hits = best.withColumn("rank", F.row_number().over(Window.orderBy("size", "asset_id")) - 1)  # at most 300 rows
    found = filters.smart_search(frame, hits.select("asset_id", "rank"), 300, 200)
    return _picked(found, F.element_at("ord", -1).cast("long").alias("place"))


_FLAGS = """
, g AS (
  SELECT asset_id,
    (CASE WHEN lower(filename) LIKE '%.mp4' THEN 1 ELSE 0 END) + (CASE WHEN lower(filename) LIKE '%99%' THEN 1 ELSE 0 END) AS hits,
    coalesce(regexp_extract(filename, '^([A-Za-z]+)', 1) = 'scan', false) AS tagged, s >= 0.9 AS seen
  FROM a)
"""


def _signals(spark, d):
    frame = _frame(spark, d)
    frame = frame.withColumns(
        {"tags": F.array(F.regexp_extract("filename", "^([A-Za-z]+)", 1)), "vision_flags": F.create_map(F.lit("x"), unit_score("score"))}
    )
    name = F.lower("filename")
    hits = frame.where(name.endswith(".mp4")).select("asset_id", F.lit("film").alias("query"))
    hits = hits.unionByName(frame.where(name.contains("99")).select("asset_id", F.lit("number").alias("query")))
    return filters.sensitive_signals(frame, blocked_tags=["scan"], negative_hits=hits, vision_threshold=0.9)


@query(ASSETS + _FLAGS + "SELECT asset_id FROM g WHERE hits = 0 AND NOT tagged AND NOT seen")
def flt_sensitive(spark, d):
    return _picked(_signals(spark, d).where(F.size("signals") == 0))


@query(
    ASSETS + _FLAGS
    + "SELECT 'negative_query' AS signal, sum(hits)::BIGINT AS n FROM g UNION ALL SELECT 'tag', count(*) FROM g WHERE tagged UNION ALL SELECT 'vision', count(*) FROM g WHERE seen"
)
def flt_sensitive_tally(spark, d):
    return filters.sensitive_tally(_signals(spark, d))


@query(ASSETS + "SELECT asset_id FROM a ORDER BY md5('3:' || asset_id) LIMIT 250")
def flt_fallback_random(spark, d):
    frame = _frame(spark, d)
    return _picked(filters.empty_pool(frame.where("false"), frame, 250, "fallback_random", 3))


_GROUPED = " SELECT asset_id, g FROM t"


def _group(df: DataFrame) -> DataFrame:
    return _picked(df, F.element_at("ctx", -1)["idx"].alias("g"))


@query(
    ASSETS + """, l AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM a WHERE us IS NOT NULL),
t AS (SELECT asset_id, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id)::BIGINT - 1 AS g FROM l),
m AS (SELECT coalesce(max(g) + 1, 0) AS g FROM t)
SELECT asset_id, g FROM t UNION ALL SELECT asset_id, g FROM a, m WHERE us IS NULL"""
)
def part_time(spark, d):
    return _group(partition.by_time(_frame(spark, d), 5.0))


@query(
    ASSETS + """, l AS (SELECT *, us - lag(us) OVER (PARTITION BY album_id ORDER BY us, asset_id) AS gap FROM a WHERE us IS NOT NULL),
t AS (SELECT album_id, asset_id, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY album_id ORDER BY us, asset_id)::BIGINT - 1 AS g FROM l),
m AS (SELECT album_id, max(g) + 1 AS n FROM t GROUP BY 1),
u AS (SELECT album_id, asset_id, g FROM t UNION ALL SELECT a.album_id, asset_id, coalesce(n, 0) FROM a LEFT JOIN m ON a.album_id IS NOT DISTINCT FROM m.album_id WHERE us IS NULL)
SELECT 'root__' || coalesce(album_id, 'none') || '_0__time_' || g AS context, count(*) AS n FROM u GROUP BY 1"""
)
def part_time_sizes(spark, d):
    split_ = partition.by_time(_by_album(_frame(spark, d)), 60.0)
    return partition.sizes(split_).select(context_id().alias("context"), "n")


def _leaders_sql(edges: str = "e", tag: str = "", rounds: int = 12) -> str:
    """CTE ``led`` (``n``, ``lead``): groups around first records over the pairs ``e`` (``i`` < ``j``), in rounds."""
    u, lead = (lambda k: f"u{tag}{k}"), (lambda k: f"l{tag}{k}")
    out = [f"{u(0)} AS (SELECT i AS n FROM {edges} UNION SELECT j FROM {edges})"]
    for k in range(1, rounds + 1):
        before = u(k - 1)
        out.append(f"{lead(k)} AS (SELECT n FROM {before} WHERE n NOT IN (SELECT j FROM {edges} WHERE i IN (SELECT n FROM {before})))")
        out.append(f"{u(k)} AS (SELECT n FROM {before} WHERE n NOT IN (SELECT n FROM {lead(k)}) AND n NOT IN (SELECT j FROM {edges} WHERE i IN (SELECT n FROM {lead(k)})))")
    every = " UNION ALL ".join(f"SELECT n FROM {lead(k)}" for k in range(1, rounds + 1))
    out.append(f"lz{tag} AS ({every})")
    out.append(f"led{tag} AS (SELECT n, n AS lead FROM lz{tag} UNION ALL SELECT j, min(i) FROM {edges} WHERE i IN (SELECT n FROM lz{tag}) AND j NOT IN (SELECT n FROM lz{tag}) GROUP BY j)")
    return ", ".join(out)


_LIBRARY = "z AS (SELECT * FROM a WHERE utc >= TIMESTAMP '1970-01-01' AND utc < TIMESTAMP '2101-01-01')"
_VECTORS = """ve AS (SELECT asset_id, max(embedding)::DOUBLE[] AS e FROM assets WHERE len(embedding) = 64 GROUP BY 1),
vk AS (SELECT asset_id, e, len(list_filter(e, lambda x: isfinite(x))) = 64 AS finite, len(list_filter(e, lambda x: x <> 0)) > 0 AS anything FROM ve)"""


def _scenes_sql(pool: str, least: float) -> str:
    """CTE ``sc`` (``asset_id``, ``g``): groups of like vectors within each ``big`` of ``pool`` (``i`` in order)."""
    return f"""{_VECTORS}, sv AS (SELECT {pool}.*, e, finite AND anything AS ok FROM {pool} LEFT JOIN vk USING (asset_id)),
es AS (SELECT x.i, y.i AS j FROM sv x JOIN sv y ON x.big = y.big AND x.i < y.i WHERE x.ok AND y.ok AND list_cosine_similarity(x.e, y.e) >= {least}),
{_leaders_sql("es", "s")}, sc AS (SELECT asset_id, coalesce(lead, i) AS g FROM sv LEFT JOIN leds ON leds.n = sv.i)"""


def _mmr_sql(pool: str) -> str:
    """CTEs ``p0``, ``p1``, ``p2``: up to three picks of each ``g`` of ``pool`` (``asset_id``, ``s``, ``g``, ``e`` or null), at most a third."""
    value = "round(CASE WHEN any_known THEN 0.3 * level + 0.7 * CASE WHEN e IS NULL THEN 0 ELSE 1 - near END ELSE s END, 12)"
    near = lambda c, p: f"coalesce(CASE WHEN {c}.e IS NOT NULL AND {p}.e IS NOT NULL THEN list_cosine_similarity({c}.e, {p}.e) END, 0)"
    best = lambda c: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {value} DESC, asset_id) AS r FROM {c}) WHERE r = 1)"
    return f"""n AS (SELECT *, least(3, greatest(1, ceil(0.33 * count(*) OVER w)), count(*) OVER w) AS most, count(e) OVER w > 0 AS any_known,
  CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1 END AS level FROM {pool} WINDOW w AS (PARTITION BY g)),
p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, asset_id) AS r FROM n) WHERE r = 1),
c1 AS (SELECT n.*, greatest(0, {near("n", "p0")}) AS near FROM n JOIN p0 USING (g) WHERE n.asset_id <> p0.asset_id AND n.most > 1),
p1 AS {best("c1")},
c2 AS (SELECT c1.* REPLACE (greatest(c1.near, {near("c1", "p1")}) AS near) FROM c1 JOIN p1 USING (g) WHERE c1.asset_id <> p1.asset_id AND c1.most > 2),
p2 AS {best("c2")}"""


_BITS = "CASE WHEN regexp_full_match(phash, '[0-9A-Fa-f]{16}') THEN ('0x' || phash)::UBIGINT END"


def _hash_groups_sql(pool: str) -> str:
    """CTE ``g`` (a row of ``pool``, ``late``, ``lead``): groups of hashes at most 6 bits apart."""
    return f"""v AS (SELECT *, row_number() OVER (ORDER BY ord, asset_id) - 1 AS i, {_BITS} AS b FROM {pool}),
d AS (SELECT b, min(i) AS n FROM v WHERE b IS NOT NULL GROUP BY b),
e AS (SELECT x.n AS i, y.n AS j FROM d x JOIN d y ON x.n < y.n AND bit_count(xor(x.b, y.b)) <= 6), {_leaders_sql()},
g AS (SELECT v.*, v.b IS NULL AS late, CASE WHEN v.b IS NULL THEN v.i ELSE coalesce(led.lead, d.n) END AS lead FROM v LEFT JOIN d USING (b) LEFT JOIN led ON led.n = d.n)"""


_PLACES = """, p AS (SELECT *, CASE WHEN isnan(latitude) THEN NULL ELSE latitude END AS lat, CASE WHEN isnan(longitude) THEN NULL ELSE longitude END AS lon FROM a)"""


@query(
    ASSETS + _PLACES + """, l AS (SELECT *, lag(us) OVER w AS us0, radians(lag(lat) OVER w) AS y0, radians(lag(lon) OVER w) AS x0, radians(lat) AS y, radians(lon) AS x
  FROM p WHERE us IS NOT NULL WINDOW w AS (ORDER BY us, asset_id)),
h AS (SELECT *, pow(sin((y - y0) / 2), 2) + cos(y0) * cos(y) * pow(sin((x - x0) / 2), 2) AS q FROM l),
t AS (SELECT asset_id, sum(CASE WHEN us - us0 <= 1800000000 AND 2 * 6371000 * atan2(sqrt(q), sqrt(1 - q)) <= 500 THEN 0 ELSE 1 END) OVER (ORDER BY us, asset_id)::BIGINT - 1 AS g FROM h),
m AS (SELECT coalesce(max(g) + 1, 0) AS g FROM t)
SELECT asset_id, g FROM t UNION ALL SELECT asset_id, g FROM a, m WHERE us IS NULL"""
)
def part_time_gps(spark, d):
    return _group(partition.by_time_and_place(_frame(spark, d), 30.0, 500.0))


@query(
    ASSETS + _PLACES + f""", l AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM p WHERE us IS NOT NULL),
t AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id)::BIGINT - 1 AS big,
  row_number() OVER (ORDER BY us, asset_id) AS i FROM l),
w AS (SELECT big, lat, lon, min(i) AS i FROM t WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY big, lat, lon),
q AS (SELECT x.i AS i, y.i AS j, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2) AS h
  FROM w x JOIN w y ON x.big = y.big AND x.i < y.i),
e AS (SELECT i, j FROM q WHERE 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) <= 500), {_leaders_sql()},
s AS (SELECT w.big, w.lat, w.lon, coalesce(lead, w.i) AS sub FROM w LEFT JOIN led ON led.n = w.i),
m AS (SELECT asset_id, t.big, coalesce(sub, 1000000000) AS sub FROM t LEFT JOIN s ON s.big = t.big AND s.lat = t.lat AND s.lon = t.lon
  UNION ALL SELECT asset_id, (SELECT coalesce(max(big) + 1, 0) FROM t), 0 FROM a WHERE us IS NULL)
SELECT asset_id, dense_rank() OVER (ORDER BY big, sub) - 1 AS g FROM m"""
)
def part_gps_anchor(spark, d):
    return _group(partition.by_time_and_anchor(_frame(spark, d), 30.0, 500.0))


@query(
    ASSETS + ", r AS (SELECT asset_id, album_id, row_number() OVER (PARTITION BY album_id ORDER BY ord, asset_id) - 1 AS i, count(*) OVER (PARTITION BY album_id) AS n FROM a) "
    "SELECT asset_id, i % least(4, n) AS g FROM r"
)
def part_evenly(spark, d):
    return _group(partition.evenly(_by_album(_frame(spark, d)), 4))


@query(ASSETS + ", " + _hash_groups_sql("a") + " SELECT asset_id, dense_rank() OVER (ORDER BY late, lead) - 1 AS g FROM g")
def part_phash(spark, d):
    return _group(partition.by_hash(_frame(spark, d), 0.90))


@query(
    ASSETS + f""", r AS (SELECT a.asset_id, album_id, v.e, row_number() OVER (ORDER BY album_id NULLS FIRST, ord, a.asset_id) AS i,
  coalesce(len(v.e) = 64 AND len(list_filter(v.e, lambda x: isfinite(x))) = 64, false) AS ok, coalesce(len(list_filter(v.e, lambda x: x <> 0)) > 0, false) AS some
  FROM a LEFT JOIN (SELECT asset_id, max(embedding)::DOUBLE[] AS e FROM assets WHERE len(embedding) = 64 GROUP BY 1) v USING (asset_id)),
e AS (SELECT x.i, y.i AS j FROM r x JOIN r y ON x.album_id IS NOT DISTINCT FROM y.album_id AND x.i < y.i
  WHERE x.ok AND y.ok AND x.some AND y.some AND list_cosine_similarity(x.e, y.e) >= 0.95), {_leaders_sql()}
SELECT asset_id, dense_rank() OVER (PARTITION BY album_id ORDER BY NOT ok, coalesce(lead, i)) - 1 AS g FROM r LEFT JOIN led ON led.n = r.i"""
)
def part_faiss(spark, d):
    return _group(partition.by_near_vectors(_by_album(_one_size(_frame(spark, d, vectors=True))), 0.95))


@query(
    ASSETS + """, v AS (SELECT asset_id, max(embedding)::DOUBLE[] AS e FROM assets WHERE len(embedding) = 64 GROUP BY 1),
r AS (SELECT a.asset_id, album_id, e, len(list_filter(e, lambda x: isfinite(x))) = 64 AS ok, len(list_filter(e, lambda x: x <> 0)) > 0 AS some,
  row_number() OVER (PARTITION BY album_id ORDER BY ord, a.asset_id) - 1 AS i FROM a JOIN v USING (asset_id)),
k AS (SELECT x.asset_id, min(y.i) AS lead FROM r x JOIN r y ON x.album_id IS NOT DISTINCT FROM y.album_id
  WHERE x.ok AND y.ok AND x.some AND y.some AND list_cosine_similarity(x.e, y.e) >= 0.85 GROUP BY 1)
SELECT r.asset_id, dense_rank() OVER (PARTITION BY album_id ORDER BY NOT ok, coalesce(lead, i)) - 1 AS g FROM r LEFT JOIN k USING (asset_id)"""
)
def part_cosine(spark, d):
    """In these tables, likeness at this threshold is transitive; hence the plain SQL."""
    usable = _frame(spark, d, vectors=True).where(F.size("embedding") == 64)
    return _group(partition.by_scene(_by_album(usable), 0.85))


@query(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 5) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.e, b.e) >= 0.35"""
)
def sim_cosine_pairs(spark, d):
    nodes = _table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
    return cosine_pairs(nodes, 0.35).withColumn("cosine", F.round("cosine", 5))


@query(
    ASSETS + """, h AS (SELECT album_id, phash, min(asset_id) AS first FROM a WHERE regexp_full_match(phash, '[0-9A-Fa-f]{16}') AND album_id IS NOT NULL GROUP BY ALL),
k AS (SELECT album_id, lower(phash) AS phash, ('0x' || phash)::UBIGINT AS b FROM h GROUP BY ALL)
SELECT x.album_id, x.phash AS a, y.phash AS b FROM k x JOIN k y ON x.album_id = y.album_id AND x.phash < y.phash WHERE bit_count(xor(x.b, y.b)) <= 6"""
)
def sim_hamming_pairs(spark, d):
    """Pairs of similar hashes within an album."""
    nodes = _frame(spark, d).select("album_id", F.lower("phash").alias("n"), bits_of_hash("phash").alias("bits")).where("bits is not null and album_id is not null").distinct()
    return hamming_pairs(nodes, 6, "album_id").select("album_id", F.col("i").alias("a"), F.col("j").alias("b"))


@query(
    ASSETS + f""", v AS (SELECT *, row_number() OVER (ORDER BY us NULLS LAST, asset_id) - 1 AS i, {_BITS} AS b, us // 86400000000 AS day, us % 86400000000 AS into_day FROM a),
w AS (SELECT * FROM v WHERE b IS NOT NULL AND us IS NOT NULL),
e AS (SELECT x.i, y.i AS j FROM w x JOIN w y ON x.day = y.day AND x.i < y.i WHERE bit_count(xor(x.b, y.b)) <= 6
  UNION SELECT x.i, y.i FROM w x JOIN w y ON x.day + 1 = y.day WHERE x.into_day >= 82800000000 AND y.into_day <= 3600000000 AND y.us - x.us <= 3600000000
  AND bit_count(xor(x.b, y.b)) <= 6), {_leaders_sql()},
m AS (SELECT lead, asset_id, row_number() OVER (PARTITION BY lead ORDER BY s DESC, asset_id) AS r, dense_rank() OVER (ORDER BY lead) - 1 AS number FROM led JOIN v ON v.i = led.n)
SELECT a.asset_id, CASE WHEN r = 1 THEN 'phash:' || number END AS group_id FROM a LEFT JOIN m USING (asset_id) WHERE coalesce(r, 1) = 1"""
)
def dedup_phash_day(spark, d):
    kept = select.drop_hash_duplicates(_frame(spark, d), 0.90)
    return _picked(kept, "group_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) GROUP BY text")
def dedup_exact_text(spark, d):
    docs = _table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n")).distinct()
    return docs.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(ASSETS + "SELECT coalesce(album_id, 'none') AS context, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY s DESC, asset_id) AS r FROM a) WHERE r = 1")
def sel_best(spark, d):
    return select.best(_by_album(_frame(spark, d))).select(F.element_at("ctx", -1)["name"].alias("context"), "asset_id")


@query(
    ASSETS + "SELECT coalesce(album_id, 'none') AS context, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY album_id "
    "ORDER BY 0.5 * least(1, greatest(0, coalesce(file_size / 8e6, 0))) + 0.5 * s DESC, asset_id) AS r FROM a) WHERE r = 1"
)
def sel_best_sharp(spark, d):
    """File size stands in for sharpness."""
    frame = _by_album(_frame(spark, d)).withColumn("sharpness", F.col("file_size") / 8e6)
    return select.best(frame).select(F.element_at("ctx", -1)["name"].alias("context"), "asset_id")


@query(
    ASSETS + "SELECT coalesce(album_id, 'none') AS context, asset_id, r - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY album_id "
    "ORDER BY s DESC, coalesce(file_size, 0) DESC, ord, asset_id) AS r FROM a) WHERE r <= 10"
)
def sel_top_n(spark, d):
    frame = _by_album(_frame(spark, d)).withColumn("exif_size", F.col("file_size"))
    return select.top_n(frame, 10).select(F.element_at("ctx", -1)["name"].alias("context"), "asset_id", F.element_at("ord", -1).alias("place"))


def _balanced_sql(pool: str, low: int, high: int) -> str:
    """Quota per month, rest by score, ties by the month that appears first."""
    return f""", b AS (SELECT asset_id, ord, raw, strftime(utc, '%Y-%m') AS m FROM {pool}),
fm AS (SELECT *, min((ord, asset_id)) OVER (PARTITION BY m) AS f, (SELECT count(DISTINCT m) FROM b) AS months FROM b),
q AS (SELECT *, CASE WHEN m IS NOT NULL AND row_number() OVER (PARTITION BY m ORDER BY raw DESC, ord, asset_id) <= greatest(1, {low} // months) THEN 0 ELSE 1 END AS later FROM fm),
o AS (SELECT *, row_number() OVER (ORDER BY later, raw DESC, (m IS NULL)::INT, f, ord, asset_id) AS r FROM q)
SELECT asset_id FROM o WHERE r <= {high}"""


@query(ASSETS + _balanced_sql("a", 300, 500))
def sel_balanced(spark, d):
    return _picked(select.balanced(_frame(spark, d)))


_SHOWN = """, hist AS (SELECT asset_id, last_shown FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC NULLS LAST, last_shown DESC NULLS LAST) AS r
  FROM publish_history WHERE asset_id IS NOT NULL) WHERE r = 1)"""


@query(_SHOWN.replace(",", "WITH", 1) + " SELECT asset_id, last_shown::VARCHAR AS last_shown FROM hist")
def hist_last_shown(spark, d):
    return _last_shown(spark, d).select("asset_id", F.col("last_shown").cast("string").alias("last_shown"))


@query(
    ASSETS + _SHOWN + """, j AS (SELECT coalesce(album_id, 'none') AS c, a.asset_id, last_shown, last_shown IS NULL OR last_shown <= DATE '2024-05-16' AS fresh FROM a LEFT JOIN hist USING (asset_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY c, fresh ORDER BY last_shown, asset_id) AS turn, count(*) FILTER (WHERE fresh) OVER (PARTITION BY c) AS have FROM j)
SELECT asset_id, NOT fresh AS fallback_backfilled FROM k WHERE fresh OR turn <= 50 - have"""
)
def sel_avoid_repeat(spark, d):
    return _picked(select.avoid_repeat(_by_album(_frame(spark, d)), RUN_DATE, 30, 50, _last_shown(spark, d)), "fallback_backfilled")


@query(
    ASSETS + """, l AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM a WHERE us IS NOT NULL),
t AS (SELECT asset_id, s, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id) AS g FROM l
  UNION ALL SELECT asset_id, s, -1 FROM a WHERE us IS NULL),
""" + _VECTORS + """, k AS (SELECT t.*, CASE WHEN finite AND anything THEN e END AS e FROM t LEFT JOIN vk USING (asset_id)), """ + _mmr_sql("k") + """
SELECT asset_id, 0 AS turn, true AS group_best FROM p0 UNION ALL SELECT asset_id, 1, false FROM p1 UNION ALL SELECT asset_id, 2, false FROM p2"""
)
def sel_diverse_pick(spark, d):
    chosen = select.diverse_pick(partition.by_time(_one_size(_frame(spark, d, vectors=True)), 5.0))
    return _picked(chosen, F.element_at("ord", -1).alias("turn"), "group_best")


@query(ASSETS + "SELECT 'images' AS branch, asset_id FROM a WHERE lower(mime_type) LIKE 'image/%' UNION ALL SELECT 'good', asset_id FROM a WHERE raw >= 0.8")
def fork_all(spark, d):
    branches = {"images": filters.non_images, "good": lambda df: filters.min_score(df, 0.8)}
    return flow.fork(_frame(spark, d), branches).select("branch", "asset_id")


@query(
    ASSETS + """, g AS (SELECT asset_id FROM a WHERE raw >= 0.8), i AS (SELECT asset_id FROM a WHERE lower(mime_type) LIKE 'image/%' AND asset_id NOT IN (SELECT asset_id FROM g))
SELECT 'good' AS branch, asset_id FROM g UNION ALL SELECT 'images', asset_id FROM i
UNION ALL SELECT 'rest', asset_id FROM a WHERE asset_id NOT IN (SELECT asset_id FROM g) AND asset_id NOT IN (SELECT asset_id FROM i)"""
)
def fork_by_selection(spark, d):
    branches = {"good": lambda df: filters.min_score(df, 0.8), "images": filters.non_images, "rest": lambda df: df}
    return flow.fork_by_selection(_frame(spark, d), branches).select("branch", "asset_id")


@query(ASSETS + "SELECT 'root__' || coalesce(album_id, 'none') || '_0' AS context, count(*) AS n FROM a GROUP BY 1")
def merge_concat(spark, d):
    joined = merge(partition.evenly(_by_album(_frame(spark, d)), 3))
    return partition.sizes(joined).select(context_id().alias("context"), "n")


@query("SELECT parent_partition_id AS parent, 'n' AS key, 'number' AS kind, count(*)::VARCHAR AS value FROM context_assets WHERE parent_partition_id IS NOT NULL GROUP BY 1")
def merge_stats(spark, d):
    rows = _table(spark, d, "context_assets").where("parent_partition_id is not null")
    children = rows.groupBy(F.col("parent_partition_id").alias("parent"), F.col("partition_id").alias("child")).agg(F.count("*").cast("string").alias("value"))
    return flow.merge_stats(children.select("parent", "child", F.lit("n").alias("key"), F.lit("number").alias("kind"), "value"))


@query("SELECT name FROM albums WHERE name IN (SELECT name FROM albums GROUP BY name HAVING count(*) > 1) GROUP BY name")
def pub_name_conflicts(spark, d):
    """Names that more than one album bears, which can't be published to by name."""
    return _table(spark, d, "albums").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")


@query(
    ASSETS + """, want AS (SELECT asset_id FROM a WHERE raw >= 0.9), have AS (SELECT DISTINCT asset_id FROM publish_history WHERE asset_id IS NOT NULL)
SELECT coalesce(want.asset_id, have.asset_id) AS asset_id, CASE WHEN have.asset_id IS NULL THEN 'add' WHEN want.asset_id IS NULL THEN 'remove' ELSE 'keep' END AS action
FROM want FULL JOIN have ON want.asset_id = have.asset_id"""
)
def pub_replace_diff(spark, d):
    return publish.album_changes(filters.min_score(_frame(spark, d), 0.9), _table(spark, d, "publish_history"))


@query("SELECT DISTINCT asset_id, 'keep' AS action FROM publish_history WHERE asset_id IS NOT NULL")
def pub_replace_refuse_empty(spark, d):
    return publish.album_changes(_frame(spark, d).where("false"), _table(spark, d, "publish_history"))


@query(
    ASSETS + _PLACES + """, r AS (SELECT asset_id, round_even(lat, 3) AS y, round_even(lon, 3) AS x FROM p)
SELECT count(*) AS n, count(DISTINCT (y, x)) AS cells FROM r WHERE y IS NOT NULL AND x IS NOT NULL"""
)
def enr_geo_cells(spark, d):
    rows = _frame(spark, d).withColumns({"y": place("latitude"), "x": place("longitude")}).where("y is not null and x is not null")
    return rows.agg(F.count("*").alias("n"), F.count_distinct(grid_key("y", "x", 3)).alias("cells"))


@query(ASSETS + ", c AS (SELECT DISTINCT asset_id FROM publish_history WHERE asset_id IS NOT NULL) SELECT count(*) AS total_assets, count(c.asset_id) AS cached, count(*) - count(c.asset_id) AS computed FROM a LEFT JOIN c USING (asset_id)")
def cache_hit_miss(spark, d):
    known = _table(spark, d, "publish_history").where("asset_id is not null").select(F.col("asset_id").alias("key"), F.lit("x").alias("value")).distinct()
    return cache.hit_counts(cache.lookup(_frame(spark, d), known, F.col("asset_id")))


@query("SELECT partition_id AS key, arg_max(asset_id, (written_at, ord, asset_id)) AS value FROM context_assets WHERE partition_id IS NOT NULL AND written_at IS NOT NULL GROUP BY 1")
def cache_compact(spark, d):
    log = _table(spark, d, "context_assets").where("written_at is not null").select(F.col("partition_id").alias("key"), F.col("asset_id").alias("value"), F.struct("written_at", "ord", "asset_id").alias("seq"))
    return cache.compact(log).select("key", "value")


@query(ASSETS + ", e AS (SELECT asset_id, max(len(embedding)) AS n FROM assets WHERE asset_id IS NOT NULL GROUP BY 1) SELECT asset_id, CASE WHEN n IS NOT NULL THEN '<omitted: ' || n || '-dim vector>' END AS note FROM e")
def exp_metadata(spark, d):
    rows = publish.export_rows(_by_album(_frame(spark, d, vectors=True)))
    return rows.select(F.get_json_object("record", "$.asset_id").alias("asset_id"), F.get_json_object("record", "$.embedding").alias("note"))


_CRON = (("0 4 * * *", "daily"), ("30 6 * * 1-5", "workdays"), ("0 0 29 2 *", "leap"), ("15 */6 1,15 * 0", "either"))


@query(
    "SELECT * FROM (VALUES ('daily', '2024-06-16 04:00'), ('workdays', '2024-06-17 06:30'), ('leap', '2028-02-29 00:00'), ('either', '2024-06-15 12:15')) t(name, next_run)"
)
def ctl_cron_next(spark, d):
    start = datetime(2024, 6, 15, 12, 0, tzinfo=UTC)
    return spark.createDataFrame([(n, f"{next_run(e, start):%Y-%m-%d %H:%M}") for e, n in _CRON], "name string, next_run string")


@query("SELECT DISTINCT id, pipeline, status, created_at FROM jobs")
def ctl_job_summaries(spark, d):
    """Job list without the logs, which the scan never reads."""
    return _table(spark, d, "jobs").select("id", "pipeline", "status", "created_at").distinct()


def _env(spark: SparkSession, sf_dir: str) -> Environment:
    assets = _assets(spark, sf_dir)
    return Environment(assets=assets, members=assets.select("album_id", "asset_id"), albums=_table(spark, sf_dir, "albums"), history=_last_shown(spark, sf_dir))


@query(
    ASSETS + ", z AS (SELECT * FROM a WHERE lower(mime_type) LIKE 'image/%' AND utc >= TIMESTAMP '1970-01-01' AND utc < TIMESTAMP '2101-01-01'), " + _hash_groups_sql("z")
    + " SELECT asset_id FROM (SELECT asset_id, row_number() OVER (PARTITION BY late, lead ORDER BY s DESC, asset_id) AS r FROM g) WHERE r = 1"
)
def composite_phash(spark, d):
    steps = [["source", {"type": "library"}], "filter.non_images", "dedup.phash_composite"]
    return _picked(run_pipeline(steps, _env(spark, d)))


def _anchor_sql(pool: str, minutes: int, metres: int) -> str:
    """CTE ``an`` (``asset_id``, ``big``, ``i``): bursts of timed records of ``pool``, divided around first places."""
    return f"""la AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM {pool}),
ta AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {minutes * 60_000_000} THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id)::BIGINT AS burst, row_number() OVER (ORDER BY us, asset_id) AS i FROM la),
wa AS (SELECT burst, lat, lon, min(i) AS i FROM ta WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY burst, lat, lon),
qa AS (SELECT x.i AS i, y.i AS j, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2) AS h
  FROM wa x JOIN wa y ON x.burst = y.burst AND x.i < y.i),
ea AS (SELECT i, j FROM qa WHERE 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) <= {metres}), {_leaders_sql("ea", "a")},
sa AS (SELECT wa.burst, wa.lat, wa.lon, coalesce(lead, wa.i) AS sub FROM wa LEFT JOIN leda ON leda.n = wa.i),
an AS (SELECT asset_id, s, i, (ta.burst, coalesce(sub, 1000000000)) AS big FROM ta LEFT JOIN sa ON sa.burst = ta.burst AND sa.lat = ta.lat AND sa.lon = ta.lon)"""


@query(
    ASSETS + _PLACES + ", " + _LIBRARY.replace("FROM a", "FROM p") + ", " + _anchor_sql("z", 5, 100) + ", " + _scenes_sql("an", 0.95)
    + " SELECT asset_id FROM (SELECT asset_id, row_number() OVER (PARTITION BY g ORDER BY s DESC, asset_id) AS r FROM sc JOIN a USING (asset_id)) WHERE r = 1"
)
def composite_similar(spark, d):
    env = _env(spark, d)
    env.assets = _one_size(env.assets)
    return _picked(run_pipeline([["source", {"type": "library"}], "dedup.similar"], env))


@query(
    ASSETS + ", " + _LIBRARY + """, lt AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM z),
tt AS (SELECT asset_id, row_number() OVER (ORDER BY us, asset_id) AS i, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id) AS big FROM lt), """
    + _scenes_sql("tt", 0.85) + ", k AS (SELECT sc.asset_id, g, s, CASE WHEN finite AND anything THEN e END AS e FROM sc JOIN a USING (asset_id) LEFT JOIN vk USING (asset_id)), " + _mmr_sql("k")
    + " SELECT asset_id, true AS group_best FROM p0 UNION ALL SELECT asset_id, false FROM p1 UNION ALL SELECT asset_id, false FROM p2"
)
def composite_scenes(spark, d):
    env = _env(spark, d)
    env.assets = _one_size(env.assets)
    return _picked(run_pipeline([["source", {"type": "library"}], "dedup.scenes"], env), "group_best")


@query()
def best_of_year(spark, d):
    env = _env(spark, d)
    env.assets = _one_size(env.assets)
    settings = {
        "by_year": {"year": 2020},
        "min_score": {"threshold": 0.2},
        "output.branches.curation.create_album": {"name": "Best of 2020"},
        "output.branches.remainder.create_album": {"name": "Rest of 2020"},
    }
    return run_pipeline("best-of-year", env, settings, RUN_DATE).select("branch", "asset_id")


@query()
def rotation(spark, d):
    settings = {"source": {"type": "library"}, "none": {"photo_count": 1_000_000_000}, "min_score": {"threshold": 0.2}, "replace_album": {"name": "Frame", "dry_run": True}}
    return _picked(run_pipeline("rotation", _env(spark, d), settings, RUN_DATE))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of fair score, in bursts of five minutes, the best of each, spread over the months."""
    steps = [
        ["source", {"type": "library"}],
        "filter.non_images",
        ["filter.min_score", {"threshold": 0.2}],
        ["partition.time", {"time_window_minutes": 5}],
        "select.best",
        "merge.concat",
        ["select.balanced", {"min_photos": 300, "max_photos": 500}],
    ]
    env = Environment(assets=_assets(spark, sf_dir).drop("embedding"))
    return run_pipeline(steps, env).select("asset_id", "captured_at", "album_id", "score")


@query(
    ASSETS + """, i AS (SELECT * FROM a WHERE lower(mime_type) LIKE 'image/%' AND raw >= 0.2 AND utc >= TIMESTAMP '1970-01-01' AND utc < TIMESTAMP '2101-01-01'),
l AS (SELECT *, us - lag(us) OVER (ORDER BY us, asset_id) AS gap FROM i),
t AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, asset_id) AS g FROM l),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, asset_id) AS best FROM t) WHERE best = 1)"""
    + _balanced_sql("z", 300, 500)
)
def curated_pool(spark, d):
    return _picked(flagship(spark, d))


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = pipeline_steps(_table(spark, sf_dir, "user_pipelines"), "steps", "id")
    values = tree_nodes(_table(spark, sf_dir, "jobs"), "pipeline_settings", "id").where("kind not in ('object', 'array')")
    of = lambda df, table, path: df.select(F.lit(table).alias("record_table"), F.col("id").alias("record_id"), F.col(path).alias("node_path"), "parent_path")
    return of(steps, "user_pipelines", "node_path").unionByName(of(values, "jobs", "path")).distinct()


@query()
def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = pipeline_steps(_table(spark, sf_dir, "user_pipelines"), "steps", "id")
    return steps.select(F.col("id").alias("record_id"), "node_id", "parent_id", "node_path", "ordinal", "branch", "stage", "alias", "config")


@query()
def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(_table(spark, sf_dir, "jobs"), "pipeline_settings", "id")
    return merged_schema(nodes).select("place", "depth", F.array_join("kinds", "|").alias("kinds"), "records")


@query()
def p5_queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(_table(spark, sf_dir, "jobs"), "pipeline_settings", "id")
    return child_table(nodes, "sensitive/negative_queries/[]", ["text", "limit"])


@query()
def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All child tables of the merged schema one after another, their columns as JSON."""
    nodes = tree_nodes(_table(spark, sf_dir, "jobs"), "pipeline_settings", "id")
    of = {t: child.select(F.lit(t).alias("table"), "node_id", "parent_row", "ordinal", F.to_json(F.struct(*child.columns[4:])).alias("fields")) for t, child in child_tables(nodes).items()}
    return reduce(DataFrame.unionByName, of.values())


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = log_entries(_table(spark, sf_dir, "jobs"), "log_output", "id", with_message=False)
    return entries.select(F.col("id").alias("job_id"), "first_line", "last_line", "ts_us", "level", "component", "message_chars")


@query()
def p6_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(_table(spark, sf_dir, "jobs"), "log_output", "id").withColumnRenamed("id", "job_id")


@query()
def p6_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_report(_table(spark, sf_dir, "jobs"), "log_output", "id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
