"""Queries that SQL can express, against DuckDB."""

import os

import pytest

from tidemark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
