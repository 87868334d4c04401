import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("normalize_records", "alt_name_views", "alt_address_parts", "block_exact_keys", "block_char_tfidf_topn", "candidate_union_score", "matching_results", "token_map_learn", "validate_output", "roc_auc", "embedding_cosine_topn")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
