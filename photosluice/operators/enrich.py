"""Enrichment with remembered results: scores, hashes, vectors, places; image kernels.

Results come from providers, plain callables over a batch, and are kept in a cache table, so that
only misses are computed. A provider runs in Arrow batches on the executors; results are
idempotent by key, so a task that runs again does no harm.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle
from photosluice.functions.scalars import grid_key, place, place_label, short_digest
from photosluice.sources.cache import lookup, tuple_key

Provider = Callable[[list[str]], list]


def score_result(raw) -> tuple[float | None, bool | None, str | None]:
    """(score, is_screenshot, error) of a scorer's answer.

    A score is limited to 0..1; an answer that is no object, or a score that is no finite number,
    is a failure; an answer with ``error`` scores 0. Only a real boolean, or the text ``true`` or
    ``false``, says whether it is a screenshot.
    """
    if not isinstance(raw, dict):
        return None, None, "invalid answer"
    if raw.get("error"):
        return 0.0, None, str(raw["error"])
    try:
        value = float(raw["score"])
    except (KeyError, TypeError, ValueError):
        return None, None, "invalid score"
    if not math.isfinite(value):
        return None, None, "invalid score"
    shot = raw.get("is_screenshot", False)
    if isinstance(shot, str):
        shot = {"true": True, "false": False}.get(shot.strip().lower())
    return min(1.0, max(0.0, value)), shot if isinstance(shot, bool) else None, None


def _computed(misses: DataFrame, provider: Provider, batch: int) -> DataFrame:
    """(``_key``, ``_made``): the provider's results as JSON text, in batches; an exception is an error of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.slice(s, batch)
                ids = part.column(1).to_pylist()
                try:
                    made = [json.dumps(x) for x in provider(ids)]
                except Exception as e:  # noqa: BLE001
                    made = [json.dumps({"failed": str(e) or type(e).__name__})] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=["_key", "_made"])

    return misses.select("_key", F.col("asset_id").cast("string")).dropDuplicates(["_key"]).mapInArrow(run, "_key string, _made string")


def remembered(df: DataFrame, key, provider: Provider | None, cache: DataFrame | None, batch: int = 16) -> DataFrame:
    """``df`` with ``_key``, ``_result`` (JSON text) and ``_cached``; misses are computed once a key."""
    looked = lookup(df, cache, key)
    if provider is None:
        return looked.select("*", F.col("_hit").alias("_result"), F.col("_hit").isNotNull().alias("_cached")).drop("_hit")
    made = settle(_computed(looked.where("_hit is null"), provider, batch), "computed")
    joined = looked.join(made, "_key", "left")
    return joined.select("*", F.coalesce("_hit", "_made").alias("_result"), F.col("_hit").isNotNull().alias("_cached")).drop("_hit", "_made")


def new_entries(results: DataFrame) -> DataFrame:
    """(``key``, ``value``) to append to the cache: computed results that are no failures."""
    bad = F.get_json_object("_result", "$.failed").isNotNull() | F.get_json_object("_result", "$.error").isNotNull()
    return results.where(~F.col("_cached") & F.col("_result").isNotNull() & ~bad).select(F.col("_key").alias("key"), F.col("_result").alias("value")).distinct()


def analyze_score(df: DataFrame, prompt: str, scorer: Provider | None, cache: DataFrame | None = None, batch: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frame with ``score``, ``is_screenshot``, ``error``, ``vision_error``; entries for the cache).

    The key is the id and a digest of the prompt. A failed answer sets the errors and leaves the
    score as it was; an answer with an error scores 0 and is not remembered.
    """
    got = remembered(df, F.concat_ws(":", "asset_id", F.lit(short_digest(prompt))), scorer, cache, batch)
    value = F.expr("try_cast(get_json_object(_result, '$.score') as double)")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    told = F.coalesce(F.get_json_object("_result", "$.error"), F.get_json_object("_result", "$.failed"))
    error = F.coalesce(told, F.when(F.col("_result").isNotNull() & ~finite, F.lit("invalid score")))
    soft = F.get_json_object("_result", "$.error").isNotNull()
    shot = F.lower(F.get_json_object("_result", "$.is_screenshot"))
    new_score = F.when(soft, F.lit(0.0)).when(finite & told.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    frame = got.withColumns(
        {
            "score": F.coalesce(new_score, "score"),
            "is_screenshot": F.coalesce(F.when(shot == "true", True).when(shot == "false", False), "is_screenshot"),
            "error": error,
            "vision_error": error,
        }
    )
    return frame.drop("_key", "_result", "_cached"), new_entries(got.where(finite | F.col("_cached")))


def hash_key():
    """Key of a hash: id, file size and time of capture."""
    return F.concat_ws(":", "asset_id", F.coalesce(F.col("file_size").cast("string"), F.lit("")), F.coalesce(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")))


def analyze_phash(df: DataFrame, hasher: Provider | None, cache: DataFrame | None = None, batch: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frame with ``phash``; entries for the cache). Hashes already set stay; a failure gives ''."""
    todo, done = df.where("phash is null"), df.where("phash is not null")
    got = remembered(todo, hash_key(), hasher, cache, batch)
    text = F.when(F.get_json_object("_result", "$.failed").isNotNull(), F.lit("")).otherwise(F.trim(F.col("_result"), F.lit('"')))
    return done.unionByName(got.withColumn("phash", text).drop("_key", "_result", "_cached")), new_entries(got)


def analyze_embedding(df: DataFrame, embedder: Provider | None, model: str = "default", cache: DataFrame | None = None, batch_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """(frame with ``embedding``; entries for the cache). Embeddings already set stay; without an
    embedder the frame passes through; an id that occurs more than once gets its vector everywhere."""
    if embedder is None and cache is None:
        return df, df.select(F.col("asset_id").alias("key"), F.lit("").alias("value")).limit(0)
    todo, done = df.where("embedding is null"), df.where("embedding is not null")
    got = remembered(todo, tuple_key(F.col("asset_id"), F.lit(model)), embedder, cache, batch_size)
    vector = F.from_json("_result", "array<float>")
    return done.unionByName(got.withColumn("embedding", vector).drop("_key", "_result", "_cached")), new_entries(got)


def nearest_places(cells: DataFrame, places: DataFrame, radius_meters: float, max_candidates: int) -> DataFrame:
    """(``_key``, ``candidates``): places within the radius of each cell, nearest first.

    ``cells`` has (``_key``, ``lat``, ``lon``), ``places`` (``name``, ``city``, ``state``,
    ``country``, ``latitude``, ``longitude``). Both are cut into a grid at least as wide as the
    radius, and a cell only meets the places of its own and the adjoining squares.
    """
    from photosluice.functions.scalars import haversine

    step = max(radius_meters / 111_000.0, 0.001)
    row = lambda c: F.floor(F.col(c) / step)
    # squares get narrower towards the poles: the columns of a row are as many as keep them wide enough
    wide = lambda r: F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(r * step), F.abs((r + 1) * step))))) / step))
    at = cells.withColumn("_r", F.explode(F.array(*[row("lat") + k for k in (-1, 0, 1)])))
    spot = lambda lon, r: F.floor((F.col(lon) + 180.0) / (360.0 / wide(r)))
    at = at.withColumn("_w", wide(F.col("_r"))).withColumn("_c", F.explode(F.array(*[F.pmod(spot("lon", F.col("_r")) + k, F.col("_w")) for k in (-1, 0, 1)]))).distinct()
    there = places.where("latitude is not null and longitude is not null").select("name", "city", "state", "country", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"))
    there = there.withColumn("_r", row("_y")).withColumn("_c", F.pmod(spot("_x", F.col("_r")), wide(F.col("_r"))))
    met = at.join(there, ["_r", "_c"]).withColumn("distance", haversine("lat", "lon", "_y", "_x")).where(F.col("distance") <= radius_meters)
    from pyspark.sql import Window

    w = Window.partitionBy("_key").orderBy("distance", "name")
    near = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_candidates)
    item = F.struct("_n", "name", "city", "state", "country", "distance")
    return near.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("_n")).alias("candidates"))


def enrich_geolocation(
    df: DataFrame,
    places: DataFrame,
    radius_meters: int = 1000,
    max_candidates: int = 5,
    cache_precision: int = 3,
    skip_if_exists: bool = True,
) -> DataFrame:
    """``df`` with ``geo``: candidates, the selected one (0), its label and the coordinates.

    Coordinates are rounded to ``cache_precision`` digits (half to even) and every distinct cell is
    looked up once. Records without a place, or without candidates, get null; a ``geo`` already set
    stays if so asked.
    """
    rows = df.withColumns({"_lat": F.bround(place("latitude"), cache_precision), "_lon": F.bround(place("longitude"), cache_precision)})
    rows = rows.withColumn("_key", F.when(F.col("_lat").isNotNull() & F.col("_lon").isNotNull(), grid_key("_lat", "_lon", cache_precision, radius_meters, max_candidates)))
    cells = rows.where("_key is not null").select("_key", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).distinct()
    found = nearest_places(cells, places, radius_meters, max_candidates)
    joined = rows.join(found, "_key", "left")
    first = F.col("candidates")[0]
    geo = F.when(
        F.size("candidates") > 0,
        F.struct(
            "candidates", F.lit(0).alias("selected_index"),
            place_label(first["name"], first["city"], first["state"], first["country"]).alias("label"),
            F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("coordinates"),
        ),
    )
    if "geo" in df.columns and skip_if_exists:
        geo = F.coalesce("geo", geo)
    return joined.withColumn("geo", geo).drop("_lat", "_lon", "_key", "candidates")


# image kernels; pixels come as rows of brightness


def _dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def perceptual_hash(luma: np.ndarray) -> str:
    """64-bit hash of a 32 x 32 brightness image: signs of its 8 x 8 lowest frequencies against their median."""
    d = _dct_matrix(32)
    low = (d @ luma.astype(float) @ d.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def sharpness(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of a brightness image over 1000, at most 1."""
    g = gray.astype(float)
    if min(g.shape) < 3:
        return 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(min(1.0, lap.var() / 1000))


def with_image_kernels(df: DataFrame, pixels_col: str = "pixels", side: int = 32) -> DataFrame:
    """``df`` with ``phash`` and ``sharpness`` of square brightness images of ``side`` * ``side`` bytes.

    Anything else gives the hash '' and sharpness 0.
    """
    if side % 32:
        raise ValueError("side must be a multiple of 32")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sharp = [], []
            for raw in b.column(pixels_col).to_pylist():
                if raw is None or len(raw) != side * side:
                    hashes.append(""), sharp.append(0.0)
                    continue
                g = np.frombuffer(raw, np.uint8).reshape(side, side)
                k = side // 32
                hashes.append(perceptual_hash(g.reshape(32, k, 32, k).mean(axis=(1, 3)))), sharp.append(sharpness(g))
            keep = [c for c in b.schema.names if c not in ("phash", "sharpness")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(hashes), pa.array(sharp)], names=[*keep, "phash", "sharpness"])

    from pyspark.sql import types as T

    kept = [f for f in df.schema if f.name not in ("phash", "sharpness")]
    schema = T.StructType([*kept, T.StructField("phash", T.StringType()), T.StructField("sharpness", T.DoubleType())])
    return df.select(*names).mapInArrow(run, schema)
