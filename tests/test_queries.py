import os
import subprocess
import sys

import duckdb
import pytest
from conftest import DATA, ROOT

from photosluice import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows_of(df, columns):
    return sorted(repr(tuple(r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = core.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: df.astype({c: "int64" for c in df.columns if str(df[c].dtype).startswith(("int", "Int", "uint")) and not df[c].isna().any()})
    assert rows_of(plain(got), columns) == rows_of(plain(want), columns)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["best_of_year", "composite_similar", "composite_scenes", "sel_diverse_pick", "part_faiss"])
def test_records_without_vectors_stay(spark, name):
    assets = spark.read.parquet(f"{DATA}/assets.parquet")
    bare = assets.where("coalesce(size(embedding), -1) <> 64").select("asset_id").distinct()
    got = core.queries()[name](spark, DATA)
    assert got.join(bare, "asset_id", "left_semi").count() > 0
    if name == "part_faiss":
        assert got.select("asset_id").distinct().count() == assets.where("asset_id is not null").select("asset_id").distinct().count()


def test_entry_and_ship(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from pyspark.sql import SparkSession;"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate();"
        "assert e.entry(s).count() > 0; print('rows', e.queries()['part_gps_anchor'](s, sys.argv[2]).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, str(ROOT), DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
