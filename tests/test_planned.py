"""Indicators by name: configuration, blocks, and columns that are not there."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tickloom.operators import affine, planned


def _bars(spark, n=300):
    rng = np.random.default_rng(1)
    rows = []
    for symbol, length in (("a", n), ("b", 40), ("c", 1)):
        close = 100 + np.cumsum(rng.normal(size=length))
        rows += [(symbol, datetime(2024, 1, 1) + timedelta(hours=4 * k), float(c), float(c + rng.random()), float(c - rng.random()), float(c), 1.0) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_names_become_a_configuration():
    assert planned.parsed(["ma20", "ma5", "rsi", "macd", "bb10", "stoch5", "ma", "unknown", "MA7", ""]) == {
        "ma": [20, 5],
        "rsi": {"period": 14},
        "macd": {"fast": 12, "slow": 26, "signal": 9},
        "bb": {"period": 10, "std": 2},
        "stoch": {"k_period": 5, "d_period": 3},
    }


def test_blocks_change_nothing(spark):
    bars = _bars(spark).persist()
    got = [planned.indicators(bars, None, n).orderBy("symbol", "ts").toPandas() for n in (24, 4096)]
    assert list(got[0].columns) == list(got[1].columns) and len(got[0]) == 341
    for c in got[0].columns[2:]:
        assert np.allclose(got[0][c].astype(float), got[1][c].astype(float), atol=1e-9, equal_nan=True), c


def test_each_equals_the_one_built_alone(spark):
    bars = _bars(spark).persist()
    got = planned.indicators(bars, ["rsi9", "adx5", "macd"], 32).orderBy("symbol", "ts").toPandas()
    for build, kwargs, names in ((affine.rsi, {"n": 9}, ["rsi"]), (affine.adx, {"n": 5}, ["adx"]), (affine.macd, {}, ["macd", "macd_signal", "macd_hist"])):
        alone = build(bars, **kwargs).orderBy("symbol", "ts").toPandas()
        for c in names:
            assert np.allclose(got[c].astype(float), alone[c].astype(float), atol=1e-9, equal_nan=True), c


def test_bare_numbers_missing_columns_and_empty_tables(spark):
    bars = _bars(spark, 30)
    assert planned.indicators(bars.drop("high"), {"ma": [3, 3, 0, -1], "rsi": 5, "atr": {"period": 3}, "other": 1}).columns == ["symbol", "ts", "open", "low", "close", "volume", "ma3", "rsi"]
    assert planned.indicators(bars.limit(0)).count() == 0
    clash = bars.selectExpr("*", "'x' AS i", "'y' AS block", "'z' AS rsi")
    rows = planned.indicators(clash, ["rsi"]).filter("symbol = 'a'").orderBy("ts").collect()
    assert [r.rsi is None for r in rows] == [True] * 14 + [False] * 16
    # a frame longer than a block makes the blocks longer
    assert planned.indicators(bars, ["ma25"], 4).filter("symbol = 'a' AND ma25 IS NOT NULL").count() == 6
    assert planned.indicators(bars, ["ma2"]).filter("symbol = 'a'").orderBy("ts").first().ma2 is None
    assert planned.indicators(bars, {"bb": {"period": 4}}).filter("symbol = 'a'").orderBy("ts").collect()[3].bb_upper == pytest.approx(
        float(np.mean([r.close for r in bars.filter("symbol = 'a'").orderBy("ts").take(4)]) + 2 * np.std([r.close for r in bars.filter("symbol = 'a'").orderBy("ts").take(4)])))
