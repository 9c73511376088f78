"""All pairs of series by blocks, against pandas and a plain walk."""

import itertools
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import pairs


def _rows(symbols, times, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=times)
    got = [(f"s{k:03d}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), float(offset + common[t] * (k % 3) + rng.normal())) for k in range(symbols) for t in range(times) if rng.random() > 0.2]
    return pd.DataFrame(got, columns=["symbol", "ts", "x"])


def _plain(df, min_n=1):
    wide = df.pivot(index="ts", columns="symbol", values="x")
    out = {}
    for a, b in itertools.combinations(sorted(wide.columns), 2):
        both = wide[[a, b]].dropna()
        if len(both) >= min_n:
            out[a, b] = (len(both), both[a].corr(both[b]))
    return out


@pytest.mark.parametrize("per_block, per_chunk, offset", [(1000, 10_000, 0.0), (7, 16, 0.0), (7, 16, 1e6)])
def test_blocks_and_chunks_change_nothing(spark, per_block, per_chunk, offset):
    df = _rows(40, 120, offset=offset)
    got = {(r.a, r.b): (r.n, r.corr) for r in pairs.correlations(spark.createDataFrame(df), "x", None, per_block, per_chunk).collect()}
    want = _plain(df)
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(c, abs=1e-7)


def test_flag_is_of_the_first_symbol(spark):
    df = _rows(12, 60)
    df["late"] = [s != "s003" and t.hour >= 12 for s, t in zip(df["symbol"], df["ts"], strict=True)]
    got = {(r.a, r.b): r for r in pairs.correlations(spark.createDataFrame(df), "x", "late", 3, 10).collect()}
    for (a, b), r in got.items():
        m = df[(df["symbol"] == a)].merge(df[df["symbol"] == b], on="ts")
        assert r.corr == pytest.approx(m["x_x"].corr(m["x_y"]), abs=1e-9)
        late = m[m["late_x"]]
        assert (r.corr_f is None) == (a == "s003")
        if a != "s003":
            assert r.corr_f == pytest.approx(late["x_x"].corr(late["x_y"]), abs=1e-9)


def test_repeats_nulls_flat_and_lonely_series(spark):
    t = [datetime(2024, 1, 1, k) for k in range(6)]
    rows = [("a", t[0], 1.0), ("a", t[0], 3.0), ("a", t[1], 2.0), ("a", t[2], 5.0), ("a", None, 9.0), (None, t[0], 9.0), ("a", t[3], float("nan")), ("a", t[4], None), ("a", t[5], float("inf"))]
    rows += [("b", t[k], v) for k, v in enumerate([2.0, 1.0, 4.0, 8.0, 1.0, 3.0])] + [("flat", t[k], 7.0) for k in range(6)] + [("once", t[1], 2.0), ("never", t[3], None)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").withColumnRenamed("x", "value").selectExpr("*", "1 AS block", "2 AS n", "3 AS i")
    got = {(r.a, r.b): (r.n, r.corr) for r in pairs.correlations(frame, "value", None, 2, 2).collect()}
    # the repeated time of a meets b's row twice
    joined = np.corrcoef([1, 3, 2, 5], [2, 2, 1, 4])[0, 1]
    assert got["a", "b"] == (4, pytest.approx(joined))
    assert got["a", "flat"] == (4, None) and got["b", "flat"] == (6, None) and got["a", "once"] == (1, None)
    assert set(got) == {("a", "b"), ("a", "flat"), ("a", "once"), ("b", "flat"), ("b", "once"), ("flat", "once")}
    assert pairs.correlations(frame.limit(0), "value").count() == 0


def test_rows_packed_grow_with_symbols_not_with_pairs(spark):
    df = spark.createDataFrame(_rows(60, 50))
    cells, blocks = pairs.packed(df, "x", None, 10, 25)
    assert 5 <= blocks <= 7 and cells.count() <= 60 * 3
    assert cells.selectExpr("sum(size(t))").first()[0] == df.count()
