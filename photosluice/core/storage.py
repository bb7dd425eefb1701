"""Intermediate tables in the folder that the cluster shares.

Lineage is cut only by tables written to the folder named in ``spark.checkpoint.dir``: every
executor can read them again after a loss. Where the setting is missing in local mode (tests), a
folder of this process takes its place; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from the session."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="photosluice-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df``, never broadcast in the join that follows.

    Tables of repeated texts and running numbers take a few bytes a row in a file and a hundred in
    memory, so that their file's size lets Spark send millions of rows through the driver.
    """
    return df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> int:
    """Delete this application's intermediate tables, once all results that read them are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        drop_path(spark, p)
    return len(paths)
