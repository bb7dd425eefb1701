import os
import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ["TZ"] = "UTC"

DATA = "/root/testdata/sf0.001"

ASSET = (
    "asset_id string, filename string, captured_at timestamp, mime_type string, latitude double, longitude double, "
    "file_size long, album_id string, score double, is_screenshot boolean, phash string, embedding array<float>"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture
def assets(spark):
    """Assets from dictionaries; what is left out is filled in."""

    def make(*rows, **extra):
        base = {
            "filename": "IMG_001.jpg", "captured_at": at("2024-06-15T12:00:00"), "mime_type": "image/jpeg", "latitude": None, "longitude": None,
            "file_size": None, "album_id": None, "score": None, "is_screenshot": False, "phash": None, "embedding": None,
        }
        names = [c.split()[0] for c in ASSET.split(", ")]
        full = []
        for r in rows:
            r = base | {k: at(v) if k == "captured_at" and isinstance(v, str) else v for k, v in r.items()}
            full.append(tuple(r.get(n) for n in names))
        return spark.createDataFrame(full, ASSET)

    return make
