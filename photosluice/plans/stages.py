"""The registered stages and the named pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame

from photosluice.operators import enrich, filters, partition, publish, select
from photosluice.operators.frames import asset_frame, merge, union_all
from photosluice.plans.spec import (
    ConfigParam as P,
)
from photosluice.plans.spec import (
    Step,
    alias_stage,
    composite,
    override,
    parse_pipeline,
    run_steps,
    stage,
    validate,
)
from photosluice.sources import library


@dataclass
class Environment:
    """Tables and providers that the stages of a run use, and what its sinks did."""

    assets: DataFrame
    members: DataFrame | None = None  # album_id, asset_id
    albums: DataFrame | None = None  # album_id, name
    history: DataFrame | None = None  # asset_id, last_shown
    faces: DataFrame | None = None  # asset_id
    places: DataFrame | None = None
    search: Any = None  # query, limit -> hits (asset_id, rank)
    scorer: Any = None
    hasher: Any = None
    embedder: Any = None
    caches: dict[str, DataFrame] = field(default_factory=dict)
    new_cache: dict[str, DataFrame] = field(default_factory=dict)
    export_directory: str | None = None
    outcomes: list[dict] = field(default_factory=list)
    writes: list[tuple[str, str, DataFrame]] = field(default_factory=list)
    observations: list | None = None  # a list to count the records after every step

    def record_counts(self) -> list[tuple[str, str, int]]:
        """(alias, stage, records after it) of a run with ``observations``, once its result was computed."""
        return [(alias, name, seen.get["records"]) for alias, name, seen in self.observations or ()]


_RUN_DATE = P("run_date", date, required=True, description="day of the run")
_COUNT = P("photo_count", int, 500, min=1)
_POOL = (P("on_empty_pool", str, "skip", choices=filters.EMPTY_POOL), P("rng_seed", int, 0))
_TIME = P("time_window_minutes", float, 5.0, min=0.1)
_PLACE = P("gps_window_meters", float, 100.0, min=0)


def _add_source(df: DataFrame | None, found: DataFrame) -> DataFrame:
    frame = asset_frame(found)
    return frame if df is None else union_all([df, frame])


@stage("retrieve.by_year", P("year", int, required=True))
def _by_year(df, env, year):
    """Add the assets of a year."""
    return _add_source(df, library.by_year(env.assets, year))


@stage(
    "source", P("type", str, "library", choices=("library", "year", "date_range", "recent", "album")), P("run_date", date), P("year", int),
    P("from", str), P("to", str), P("days", int), P("weeks", int), P("months", int), P("album_id", str),
)
def _source(df, env, type, run_date, **p):
    """Add the assets of a scope."""
    return _add_source(df, library.build_source(env.assets, type, run_date, env.members, **p))


@stage("analyze.score", P("prompt", str, ""), P("prompt_file", str), P("concurrency", int, 4, min=1))
def _score(df, env, prompt, prompt_file, concurrency):
    """Score what has no score yet."""
    if prompt_file:
        if ".." in prompt_file:
            raise ValueError("prompt_file must not leave its folder")
        with open(prompt_file) as f:
            prompt = f.read()
    if env.scorer is None:
        return df
    out, env.new_cache["score"] = enrich.analyze_score(df, prompt, env.scorer, env.caches.get("score"), concurrency)
    return out


@stage("analyze.phash", P("concurrency", int, 4, min=1))
def _phash(df, env, concurrency):
    """Hash what has no hash yet."""
    if env.hasher is None:
        return df
    out, env.new_cache["phash"] = enrich.analyze_phash(df, env.hasher, env.caches.get("phash"), concurrency)
    return out


@stage("analyze.embedding", P("concurrency", int, 4, min=1), P("batch_size", int, 16, min=1))
def _embedding(df, env, concurrency, batch_size):
    """Embed what has no embedding yet."""
    if env.embedder is None:
        return df
    out, env.new_cache["embedding"] = enrich.analyze_embedding(df, env.embedder, cache=env.caches.get("embedding"), batch_size=batch_size)
    return out


@stage(
    "enrich.geolocation", P("radius_meters", int, 1000, min=50, max=50_000), P("max_candidates", int, 5, min=1, max=20),
    P("cache_precision", int, 3, min=2, max=5), P("concurrency", int, 2, min=1, max=10), P("skip_if_exists", bool, True), P("place_type", str),
)
def _geo(df, env, radius_meters, max_candidates, cache_precision, concurrency, skip_if_exists, place_type):
    """Name the place of each record."""
    if env.places is None:
        return df
    places = env.places if not place_type or "type" not in env.places.columns else env.places.where(env.places["type"] == place_type)
    return enrich.enrich_geolocation(df, places, radius_meters, max_candidates, cache_precision, skip_if_exists)


@stage("filter.non_images")
def _non_images(df, env):
    """Keep images."""
    return filters.non_images(df)


@stage("filter.min_score", P("threshold", float, 0.0, min=0, max=1))
def _min_score(df, env, threshold):
    """Keep scores from a threshold on."""
    return filters.min_score(df, threshold)


@stage("filter.screenshots")
def _screenshots(df, env):
    """Drop screenshots."""
    return filters.screenshots(df)


@stage("filter.none", _COUNT)
def _none(df, env, photo_count):
    """Keep the first records."""
    return filters.first_n(df, photo_count)


@stage("filter.random", _COUNT, P("rng_seed", int))
def _random(df, env, photo_count, rng_seed):
    """Keep a random sample."""
    return filters.random_sample(df, photo_count, rng_seed)


@stage("filter.on_this_day", _RUN_DATE, _COUNT, *_POOL)
def _on_this_day(df, env, run_date, photo_count, on_empty_pool, rng_seed):
    """Keep what was captured on this day of any year."""
    return filters.empty_pool(filters.on_this_day(df, run_date), df, photo_count, on_empty_pool, rng_seed)


@stage("filter.people", _COUNT, *_POOL)
def _people(df, env, photo_count, on_empty_pool, rng_seed):
    """Keep records with a known face."""
    if env.faces is None:
        raise ValueError("filter.people needs a table of faces")
    return filters.empty_pool(filters.people(df, env.faces), df, photo_count, on_empty_pool, rng_seed)


@stage("filter.smart_search", P("query", str, required=True), P("max_candidates", int, 500, min=1), _COUNT, *_POOL)
def _search(df, env, query, max_candidates, photo_count, on_empty_pool, rng_seed):
    """Keep the first hits of a search."""
    if env.search is None:
        raise ValueError("filter.smart_search needs a search provider")
    found = filters.smart_search(df, env.search(query, max_candidates), max_candidates, photo_count)
    if on_empty_pool == "skip":
        return found
    return filters.empty_pool(found, df, photo_count, on_empty_pool, rng_seed)


@stage(
    "filter.sensitive", P("enabled", bool, False), P("fail_closed", bool, False), P("blocklist_ids", list, ()), P("blocked_tags", list, ()),
    P("negative_queries", list, ()), P("negative_query_limit", int, 500, min=1), P("vision_threshold", float, 0.7, min=0, max=1),
)
def _sensitive(df, env, enabled, fail_closed, blocklist_ids, blocked_tags, negative_queries, negative_query_limit, vision_threshold):
    """Drop what should not be shown."""
    hits = None
    if enabled and negative_queries:
        if env.search is None:
            raise ValueError("negative_queries need a search provider")
        from pyspark.sql import functions as F

        hits = union_all([env.search(q, negative_query_limit).select("asset_id", F.lit(q).alias("query")) for q in negative_queries])
    return filters.sensitive(
        df, enabled, blocklist_ids=blocklist_ids, blocked_tags=blocked_tags, negative_hits=hits, vision_threshold=vision_threshold, fail_closed=fail_closed
    )


@stage("partition.time", _TIME)
def _time(df, env, time_window_minutes):
    """Split at gaps in time."""
    return partition.by_time(df, time_window_minutes)


@stage("partition.time_gps", _TIME, _PLACE)
def _time_gps(df, env, time_window_minutes, gps_window_meters):
    """Split at gaps in time or place."""
    return partition.by_time_and_place(df, time_window_minutes, gps_window_meters)


@stage("partition.time_gps_anchor", _TIME, _PLACE)
def _time_gps_anchor(df, env, time_window_minutes, gps_window_meters):
    """Split at gaps in time, then by the places of first records."""
    return partition.by_time_and_anchor(df, time_window_minutes, gps_window_meters)


@stage("partition.phash", P("threshold", float, 0.90, min=0, max=1))
def _part_phash(df, env, threshold):
    """Split by similar hashes."""
    return partition.by_hash(df, threshold)


@stage("partition.faiss", P("threshold", float, 0.95, min=-1, max=1))
def _part_faiss(df, env, threshold):
    """Split by near-identical embeddings."""
    return partition.by_near_vectors(df, threshold)


@stage("partition.cosine", P("threshold", float, 0.85, min=-1, max=1))
def _part_cosine(df, env, threshold):
    """Split by scene."""
    return partition.by_scene(df, threshold)


alias_stage("partition.scene", "partition.cosine")


@stage("partition.evenly", P("number_of_partitions", int, 4, min=1))
def _evenly(df, env, number_of_partitions):
    """Deal in turn."""
    return partition.evenly(df, number_of_partitions)


@stage("merge.concat")
def _merge(df, env):
    """Undo one split."""
    return merge(df)


@stage("select.best")
def _best(df, env):
    """The best record of each context."""
    return select.best(df)


@stage("select.top_n", P("count", int, 10, min=1))
def _top_n(df, env, count):
    """The top records of each context."""
    return select.top_n(df, count)


@stage("select.balanced", P("min_photos", int, 300, min=0), P("max_photos", int, 500, min=1))
def _balanced(df, env, min_photos, max_photos):
    """Spread over months."""
    return select.balanced(df, min_photos, max_photos)


@stage(
    "select.diverse_pick", P("max_picks", int, 3, min=1), P("pick_percentage", float, 0.33, min=0, max=1),
    P("quality_weight", float, 0.3, min=0), P("diversity_weight", float, 0.7, min=0),
)
def _diverse(df, env, **p):
    """Good and dissimilar records of each context."""
    return select.diverse_pick(df, **p)


@stage("avoid_repeat", _RUN_DATE, P("days", int, 30, min=0), _COUNT)
def _avoid_repeat(df, env, run_date, days, photo_count):
    """Prefer what was not shown lately."""
    return select.avoid_repeat(df, run_date, days, photo_count, env.history)


@stage("dedup.phash", P("threshold", float, 0.90, min=0, max=1))
def _dedup_phash(df, env, threshold):
    """Drop near duplicates of a day."""
    return select.drop_hash_duplicates(df, threshold)


composite("dedup.phash_composite", ("analyze.phash", {}, "hash"), ("partition.phash", {}, "phash"), ("select.best", {}, "best"), ("merge.concat", {}, "merge"), description="One of each group of similar hashes.")
composite(
    "dedup.similar", ("analyze.embedding", {}, "embedding"), ("partition.time_gps_anchor", {}, "events"), ("partition.faiss", {}, "near"),
    ("select.best", {}, "best"), ("merge.concat", {}, "merge"), ("merge.concat", {}, "merge_2"), description="The best of each group of near-identical records of an event.",
)
composite(
    "dedup.scenes", ("analyze.embedding", {}, "embedding"), ("partition.time", {}, "events"), ("partition.cosine", {}, "scenes"),
    ("select.diverse_pick", {}, "pick"), ("merge.concat", {}, "merge"), ("merge.concat", {}, "merge_2"), description="A few of each scene.",
)


def _no_branches(df, env, **_):
    raise ValueError("a fork needs branches")


stage("fork", P("note", str), P("parallel", bool), description="Run branches on the same records.")(_no_branches)
stage("fork.by_selection", P("note", str), P("parallel", bool), description="Run branches on what those before left.")(_no_branches)


@stage("publish.create_album", P("name", str, required=True), P("dry_run", bool, False), P("run_date", date))
def _create_album(df, env, name, dry_run, run_date):
    """Put the records into a new album."""
    if env.albums is None:
        raise ValueError("publish.create_album needs a table of albums")
    outcome, rows = publish.create_album(df, env.albums, name, dry_run)
    env.outcomes.append(outcome | {"stage": "publish.create_album"})
    if outcome.get("created"):
        env.writes.append(("members", name, rows))
        if run_date:
            env.writes.append(("history", name, publish.history_rows(df, run_date)))
    return df


@stage("publish.replace_album", P("name", str, required=True), P("dry_run", bool, False), P("allow_empty", bool, False), P("run_date", date))
def _replace_album(df, env, name, dry_run, allow_empty, run_date):
    """Make an album hold exactly the records."""
    if env.albums is None or env.members is None:
        raise ValueError("publish.replace_album needs tables of albums and members")
    of = env.albums.where(env.albums["name"] == name).select("album_id")
    outcome, changes = publish.replace_album(df, env.members.join(of, "album_id", "left_semi"), name, dry_run, allow_empty)
    env.outcomes.append(outcome | {"stage": "publish.replace_album"})
    if not dry_run and not outcome.get("refused_empty"):
        env.writes.append(("changes", name, changes))
        if run_date:
            env.writes.append(("history", name, publish.history_rows(df, run_date)))
    return df


@stage(
    "export.context", P("export_directory", str, "./output"), P("image_size", str, "thumbnail", choices=("thumbnail", "original")),
    P("concurrency", int, 4, min=1), P("include_embeddings", bool, False),
)
def _export(df, env, export_directory, image_size, concurrency, include_embeddings):
    """Write the contexts as JSON."""
    path = publish.export_contexts(df, env.export_directory or export_directory, include_embeddings)
    env.outcomes.append({"stage": "export.context", "output_dir": path, "image_size": image_size})
    return df


PIPELINES: dict[str, tuple[str, list]] = {
    "best-of-year": (
        "The best of a year, and what is left over.",
        [
            ["retrieve.by_year", {}],
            "filter.non_images",
            ["analyze.score", {}],
            "analyze.phash",
            ["filter.min_score", {}],
            "filter.screenshots",
            ["fork.by_selection", {"branches": {
                "curation": ["dedup.phash_composite", "dedup.similar", "dedup.scenes", "select.balanced", ["publish.create_album", {"name": "Best of {YEAR}"}]],
                "remainder": [["publish.create_album", {"name": "Rest of {YEAR}"}]],
            }}, "output"],
        ],
    ),
    "rotation": (
        "A fresh selection for a frame.",
        [
            ["source", {}],
            "filter.none",
            "filter.non_images",
            ["filter.sensitive", {}],
            ["analyze.score", {}],
            ["filter.min_score", {}],
            "analyze.phash",
            "dedup.phash",
            "avoid_repeat",
            "select.balanced",
            ["publish.replace_album", {"name": "Frame"}],
        ],
    ),
}


def named_pipeline(name: str, settings: dict | None = None, run_date: date | None = None) -> tuple[Step, ...]:
    """A named pipeline with settings by alias, checked."""
    if name not in PIPELINES:
        raise KeyError(f"unknown pipeline {name!r}")
    return validate(override(parse_pipeline(PIPELINES[name][1]), settings or {}), {"run_date": run_date} if run_date else None)


def run_pipeline(pipeline, env: Environment, settings: dict | None = None, run_date: date | None = None, frame: DataFrame | None = None) -> DataFrame:
    """Check a pipeline, then build its frame; only sinks, forks and clustering act at once.

    ``pipeline`` is a name, JSON text, written steps or parsed ones.
    """
    if isinstance(pipeline, str) and pipeline in PIPELINES:
        steps = named_pipeline(pipeline, settings, run_date)
    else:
        steps = validate(override(parse_pipeline(pipeline), settings or {}), {"run_date": run_date} if run_date else None)
    return run_steps(frame, env, steps)


def validate_user_steps(raw) -> list[str]:
    """What is wrong with a written pipeline, step by step; an empty list if nothing is."""
    try:
        validate(parse_pipeline(raw))
    except (ValueError, KeyError, TypeError) as e:
        return [str(e.args[0]) if e.args else str(e)]
    return []
