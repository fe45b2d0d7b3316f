import os

import pytest

from lattiq import ingest_queries, queries

QUERIES, SQL = queries.QUERIES | ingest_queries.QUERIES, queries.SQL | ingest_queries.SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert len(got) == len(want)
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DIR):
        assert e.entry(spark).limit(5).count() == 5
