"""Every query with SQL gives the same rows in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLES:
        assert rows(got.toPandas()) == rows(con.sql(catalogue.ORACLES[name]).df())
    else:
        assert got.count() > 0
