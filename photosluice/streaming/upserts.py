"""Streams: bursts of captures as sessions, and a history kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from photosluice.sources.cache import latest


def burst_sessions(captures: DataFrame, *keys: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(``keys``, ``start``, ``stop``, ``records``) of bursts in a stream of captures.

    A burst is closed once no record ``late`` or less behind the newest can still join it. Streams
    have sessions only by key, such as the album or the camera.
    """
    if not keys:
        raise ValueError("sessions of a stream need a key")
    timed = captures.where("captured_at is not null").withWatermark("captured_at", late)
    session = F.session_window("captured_at", gap)
    return timed.groupBy(session, *keys).agg(F.count("*").alias("records")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "records")


def keep_history(shown: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of (``asset_id``, ``last_shown``, ``recorded_at``) to the history at ``path``, batch by batch.

    Each batch is reduced to the latest row of an id and written to a folder of its own number, so
    that a batch run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        few = batch.groupBy("asset_id").agg(F.max_by(F.struct("last_shown", "recorded_at"), F.struct("recorded_at", "last_shown")).alias("r")).select("asset_id", "r.*")
        few.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return shown.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark, path: str) -> DataFrame:
    """(``asset_id``, ``last_shown``) as of the latest record of each id."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return latest(rows, "asset_id", "recorded_at", "last_shown")
