"""Queries of the training-data operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def effective_score(df: DataFrame) -> DataFrame:
    """(``id``, ``score``) once an asset: null and NaN count as 0, others are limited to 0..1."""
    s = F.col("score")
    clean = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))
    return df.where("asset_id is not null").groupBy(F.col("asset_id").alias("id")).agg(F.max(clean).alias("score"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.density_clusters import density_clusters

    found = density_clusters(_table(spark, sf_dir, "assets"), mutual=True)
    return found.select("cluster_key", F.col("id").alias("asset_id"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.density_clusters import density_clusters, exemplars

    assets = _table(spark, sf_dir, "assets")
    return exemplars(density_clusters(assets), effective_score(assets)).withColumnRenamed("id", "asset_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.neighbours import neighbour_pairs

    return neighbour_pairs(_table(spark, sf_dir, "assets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.coverage import pick_varied

    t = [_table(spark, sf_dir, x) for x in ("pick_requests", "context_assets", "assets")]
    return pick_varied(*t).select("request_id", "asset_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.top_groups import top_of_contexts

    top = top_of_contexts(_table(spark, sf_dir, "context_assets"), _table(spark, sf_dir, "assets"))
    return top.select(F.col("grp").alias("partition_id"), F.col("id").alias("asset_id"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.packing import fill_report

    return fill_report(p7_packed(spark, sf_dir), _table(spark, sf_dir, "pack_sizes"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.core.storage import settle
    from photosluice.llm.packing import pack_faults

    return pack_faults(settle(p7_packed(spark, sf_dir), "packed"), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_sizes"))


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.mixing import mix_report

    return mix_report(p8_mixed(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.core.storage import settle
    from photosluice.llm.mixing import mix_faults

    return mix_faults(settle(p8_mixed(spark, sf_dir), "mixed"), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.spans import shared_spans

    return shared_spans(_table(spark, sf_dir, "documents"))


def p9_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photosluice.llm.spans import shared_parts

    return shared_parts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_clusters": p1_clusters,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p7_packed": p7_packed,
        "p7_fill": p7_fill,
        "p7_faults": p7_faults,
        "p8_mixed": p8_mixed,
        "p8_shares": p8_shares,
        "p8_faults": p8_faults,
        "p9_found": p9_found,
        "p9_parts": p9_parts,
    }


# usable embeddings, one row an asset, in double
_VECTORS = """
v AS (SELECT asset_id, max(embedding) AS e FROM assets WHERE asset_id IS NOT NULL AND len(embedding) = 64 GROUP BY 1),
u AS (SELECT asset_id, e::DOUBLE[64] AS e FROM v
  WHERE len(list_filter(e, lambda x: isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0)
"""
_SCORES = """
s AS (SELECT asset_id, max(CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE least(1, greatest(0, score)) END) AS score
  FROM assets WHERE asset_id IS NOT NULL GROUP BY 1)
"""

# In these tables likeness is transitive, so that a group is what its members resemble.
_SQL = {
    "p1_found": f"""WITH {_VECTORS},
p AS (SELECT a.asset_id, min(b.asset_id) AS cluster_key, count(*) AS n FROM u a JOIN u b ON array_cosine_similarity(a.e, b.e) >= 0.86 GROUP BY 1)
SELECT cluster_key, asset_id FROM p WHERE n >= 3""",
    "p2_found": f"""WITH {_VECTORS},
p AS (SELECT a.asset_id AS x, b.asset_id AS y, array_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.asset_id <> b.asset_id
  WHERE array_cosine_similarity(a.e, b.e) >= 0.86),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY round(c, 6) DESC, y) AS r FROM p)
SELECT DISTINCT least(x, y) AS asset_a, greatest(x, y) AS asset_b FROM r WHERE r <= 5""",
    "p3_found": f"""WITH {_VECTORS}, {_SCORES},
m AS (SELECT DISTINCT request_id, pick_size, c.asset_id, e, score FROM pick_requests JOIN context_assets c USING (partition_id)
  JOIN u ON u.asset_id = c.asset_id JOIN s ON s.asset_id = c.asset_id),
k AS (SELECT a.request_id, a.asset_id, min(b.asset_id) AS kind FROM m a JOIN m b ON a.request_id = b.request_id
  WHERE a.asset_id = b.asset_id OR array_cosine_similarity(a.e, b.e) >= 0.86 GROUP BY 1, 2),
p AS (SELECT request_id, asset_id, pick_size, score, row_number() OVER (PARTITION BY request_id, kind ORDER BY score DESC, asset_id) AS place
  FROM m JOIN k USING (request_id, asset_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place, score DESC, asset_id) AS r FROM p)
SELECT request_id, asset_id FROM o WHERE r <= pick_size""",
    "p4_found": f"""WITH {_SCORES},
m AS (SELECT DISTINCT partition_id, asset_id FROM context_assets WHERE partition_id IS NOT NULL AND asset_id IS NOT NULL),
r AS (SELECT partition_id, m.asset_id, row_number() OVER (PARTITION BY partition_id ORDER BY coalesce(score, 0) DESC, m.asset_id) AS r
  FROM m LEFT JOIN s USING (asset_id))
SELECT partition_id, asset_id FROM r WHERE r <= 3""",
    # no unique answer: what any answer must keep
    "p7_faults": """WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE length(text) > 0)
SELECT DISTINCT pack_id, n AS documents, 0 AS lost, 0 AS overfull, 0 AS repeated, 0 AS split FROM pack_sizes, n WHERE capacity_tokens > 0""",
    "p8_faults": """WITH s AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(source), '[\\s\\p{Z}\\-_./]+', '_', 'g'), '^_+|_+$', '', 'g') AS source
  FROM documents WHERE length(text) > 0)
SELECT DISTINCT mix_id, source, 0 AS too_often, 0 AS foreign, false AS missed FROM mix_targets JOIN s USING (source) WHERE target_share > 0 AND max_repeats > 0""",
    "p9_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 160 GROUP BY ALL),
w AS (SELECT doc_id, p, substr(text, p + 1, 160) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) - 159)) AS p FROM d)),
h AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT doc_id, p FROM w WHERE t IN (SELECT t FROM h)),
g AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 160 THEN 0 ELSE 1 END AS new FROM f),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g)
SELECT doc_id, min(p) AS span_start, max(p) - min(p) + 160 AS span_chars FROM n GROUP BY doc_id, run""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
