"""The training-data queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from quern.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    df, found = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    places = [found.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[i] for i in places]) for r in found.fetchall())
