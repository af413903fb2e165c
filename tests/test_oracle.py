"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from quern.plans import ALL_QUERIES, ALL_SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6))
    return value.isoformat()[:19] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_same_rows(spark, sf, db, name):
    df = ALL_QUERIES[name](spark, sf)
    found = db.sql(ALL_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    places = [found.columns.index(c) for c in names]
    assert ours == sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(ALL_QUERIES) - set(ALL_SQL)))
def test_rows_only(spark, sf, name):
    assert ALL_QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
