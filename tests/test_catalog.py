"""Every query with SQL gives the rows that the SQL gives, and no query is empty."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from lexmill.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shown(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, (pd.Timestamp, dt.date)):
        return str(pd.Timestamp(x).date())
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def rows(frame):
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
