"""The queries of this subpackage that have SQL, against DuckDB on small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tickloom.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, str)) else float(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
