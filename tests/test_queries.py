"""Every query of the core that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tickloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace(" 00:00:00", "")
    if isinstance(v, (bool, str)):
        return v
    return float(f"{float(v):.11g}") + 0.0


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_names_of_sql_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
