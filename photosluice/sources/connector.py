"""A data source over any paged library of assets, read in parallel by time ranges.

The client is a factory that can be sent to executors; what it makes answers
``search(start, stop, page, size)`` with a list of rows (dictionaries), an empty one after the last.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "asset_id string, filename string, captured_at timestamp, mime_type string, latitude double, longitude double, "
    "file_size bigint, album_id string, score double, is_screenshot boolean, phash string, embedding array<float>"
)


class _Range(InputPartition):
    def __init__(self, start: datetime, stop: datetime):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[_Range]:
        start, stop = (datetime.fromisoformat(self.options[k]) for k in ("start", "stop"))
        n = max(1, int(self.options.get("ranges", "8")))
        step = (stop - start) / n
        edges = [start + step * i for i in range(n)] + [stop]
        return [_Range(a, b) for a, b in zip(edges, edges[1:]) if b - a > timedelta(0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        client = cloudpickle.loads(base64.b64decode(self.options["client"]))()
        size, page = int(self.options.get("pagesize", "500")), 0
        while rows := client.search(partition.start, partition.stop, page, size):
            for r in rows:
                yield tuple(r.get(n) for n in self.names)
            page += 1


class AssetLibrary(DataSource):
    """Format ``asset_library`` with the options ``client``, ``start``, ``stop``, ``ranges`` and ``pagesize``."""

    @classmethod
    def name(cls) -> str:
        return "asset_library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), [f.name for f in schema])


def read_library(spark: SparkSession, client: Callable, start: datetime, stop: datetime, ranges: int = 8, page_size: int = 500) -> DataFrame:
    """Assets that the client finds in [start, stop), each of ``ranges`` parts of it read by a task."""
    spark.dataSource.register(AssetLibrary)
    packed = base64.b64encode(cloudpickle.dumps(client)).decode()
    options = {"client": packed, "start": start.isoformat(), "stop": stop.isoformat(), "ranges": str(ranges), "pagesize": str(page_size)}
    return spark.read.format("asset_library").options(**options).load()


def read_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``length``, ``content``) of files, such as pictures, on a shared file system."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
