"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=str)
    assert got == sorted(([plain(r[want.columns.index(c)]) for c in order] for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
