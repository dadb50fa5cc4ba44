"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from quern.plans import registry

FOLDER = os.environ.get("QUERN_TEST_TABLES", "/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(["" if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r]) for r in frame.values.tolist())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not glob.glob(f"{FOLDER}/*.parquet"):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, FOLDER).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, duck):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "score", "rank"] and df.count() == 10
