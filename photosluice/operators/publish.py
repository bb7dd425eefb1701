"""Sinks: albums by difference, history of what was shown, export of contexts."""

from __future__ import annotations

from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.functions.scalars import asset_file_name
from photosluice.operators.frames import KEYS, context_id, ranked
from photosluice.sources.library import as_day


def published(df: DataFrame) -> DataFrame:
    """The distinct ids over all contexts."""
    return df.select("asset_id").where("asset_id is not null").distinct()


def create_album(df: DataFrame, albums: DataFrame, name: str, dry_run: bool = False) -> tuple[dict, DataFrame]:
    """(what happened, rows to add to the album's members).

    An album of exactly that name is a conflict and nothing is added. A dry run adds nothing.
    """
    wanted = published(df)
    if albums.where(F.col("name") == name).limit(1).count():
        return {"conflict": True, "created": False, "name": name}, wanted.limit(0)
    count = wanted.count()
    if dry_run:
        return {"dry_run": True, "would_create": count, "name": name}, wanted.limit(0)
    return {"conflict": False, "created": True, "name": name, "asset_count": count}, wanted


def album_changes(desired: DataFrame, current: DataFrame, allow_empty: bool = False) -> DataFrame:
    """(``asset_id``, ``action``): ``add``, ``remove`` or ``keep``, from two tables with ``asset_id``.

    An album that holds something is not emptied unless allowed: its records are then ``keep``.
    """
    want = published(desired).withColumn("_want", F.lit(True))
    have = published(current).withColumn("_have", F.lit(True))
    both = want.join(have, "asset_id", "full_outer")
    action = F.when(F.col("_have").isNull(), "add").when(F.col("_want").isNotNull(), "keep").otherwise("remove")
    out = both.select("asset_id", action.alias("action"))
    if allow_empty or published(desired).limit(1).count():
        return out
    return out.withColumn("action", F.lit("keep"))


def replace_album(df: DataFrame, current: DataFrame, name: str, dry_run: bool = False, allow_empty: bool = False) -> tuple[dict, DataFrame]:
    """(what happened, changes) to make the album hold exactly the frame's records."""
    changes = album_changes(df, current, allow_empty)
    n = {r["action"]: r["count"] for r in changes.groupBy("action").count().collect()}
    wanted, held = published(df).limit(1).count(), current.limit(1).count()
    if not wanted and held and not allow_empty:
        return {"refused_empty": True, "name": name, "added": 0, "removed": 0}, changes
    if dry_run:
        return {"dry_run": True, "name": name, "would_add": n.get("add", 0), "would_remove": n.get("remove", 0)}, changes
    return {"name": name, "added": n.get("add", 0), "removed": n.get("remove", 0), "final_count": n.get("add", 0) + n.get("keep", 0)}, changes


def history_rows(df: DataFrame, run_date: date | str) -> DataFrame:
    """(``asset_id``, ``last_shown``) to append for everything published."""
    return published(df).withColumn("last_shown", F.lit(as_day(run_date)))


def export_rows(df: DataFrame, include_embeddings: bool = False) -> DataFrame:
    """The frame as rows to export: ``context_id``, ``position``, ``file_name`` and ``record`` as JSON.

    Embeddings are replaced by a note of their size unless asked for.
    """
    rest = [c for c in df.columns if c not in (*KEYS, "ord")]
    if "embedding" in rest and not include_embeddings:
        note = F.when(F.col("embedding").isNotNull(), F.concat(F.lit("<omitted: "), F.size("embedding").cast("string"), F.lit("-dim vector>")))
        df = df.withColumn("embedding", note)
    placed = ranked(df, KEYS, "_position", F.asc("ord"), F.asc("asset_id"))
    return placed.select(
        "branch",
        context_id().alias("context_id"),
        F.col("_position").alias("position"),
        asset_file_name("asset_id", "mime_type").alias("file_name"),
        F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("record"),
    )


def export_contexts(df: DataFrame, directory: str, include_embeddings: bool = False) -> str:
    """Write one folder of JSON records a context below ``directory``; returns its path."""
    path = str(PurePosixPath(directory) / "contexts") if "://" not in directory else f"{directory.rstrip('/')}/contexts"
    export_rows(df, include_embeddings).write.mode("overwrite").partitionBy("branch", "context_id").json(path)
    return path
