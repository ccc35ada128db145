"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from barograph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(pd.Timestamp(v))
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_are_those_of_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
