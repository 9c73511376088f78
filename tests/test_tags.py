"""Scores over splits of time, tags by them, and tiers of a save."""

import itertools
from datetime import datetime

import pytest

from tickloom.operators import research
from tickloom.sources import files


def test_scores_equal_all_splits_and_missing_keys_are_not_validated(spark):
    rows = [(k, sec, float((sec * 7 + len(k)) % 11 - shift)) for k, shift in (("good", 1), ("bad", 9)) for sec in range(0, 60, 3)]
    rows += [("short", 0, 5.0), (None, 0, 1.0), ("nopnl", 1, None), ("good", None, 1e9)]
    trades = spark.createDataFrame(rows, "k string, sec long, pnl double")
    got = {r.k: r for r in research.split_scores(trades, ["k"], 4).collect()}
    assert set(got) == {"good", "bad"}
    for k in got:
        mine = [(sec * 4 // 58, pnl) for key, sec, pnl in rows if key == k and sec is not None]
        means = [sum(p for g, p in mine if g in two) / sum(g in two for g, _ in mine) for two in itertools.combinations(range(4), 2)]
        assert got[k].cpcv_score == pytest.approx(sum(means) / 6) and got[k].positive == pytest.approx(sum(m > 0 for m in means) / 6)
    keys = spark.createDataFrame([("good",), ("bad",), ("short",), (None,)], "k string")
    tags = {r.k: (r.cpcv_score is not None, r.cpcv_validated) for r in research.tagged(keys, research.split_scores(trades, ["k"], 4), ["k"]).collect()}
    assert tags == {"good": (True, True), "bad": (True, False), "short": (False, False), None: (False, False)}
    assert research.split_scores(trades.limit(0), ["k"]).count() == 0


def test_tiers_are_found_in_order(spark, tmp_path):
    bars = spark.createDataFrame([(s, datetime(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 10.0) for s in "ab" for d in (1, 2)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    files.write_tiers(bars, f"{tmp_path}/one", ("parquet", "binary"))
    files.write_tiers(bars, f"{tmp_path}/all")
    want = sorted(bars.collect())
    for at, tiers in (("one", (None, "binary", "parquet")), ("all", (None, *files.TIERS))):
        for tier in tiers:
            assert sorted(files.read_tier(spark, f"{tmp_path}/{at}", tier).collect()) == want, (at, tier)
    assert files.read_tier(spark, f"{tmp_path}/all", None, "2024-01-02").count() == 2
    files.write_tiers(bars.filter("symbol = 'a'").withColumn("close", bars.close + 1), f"{tmp_path}/all")
    for tier in files.TIERS:
        assert sorted((r.symbol, r.close) for r in files.read_tier(spark, f"{tmp_path}/all", tier).collect()) == [("a", 2.5), ("a", 2.5), ("b", 1.5), ("b", 1.5)], tier
    for bad in ("arrow", "other"):
        with pytest.raises(ValueError, match="no tier"):
            files.read_tier(spark, f"{tmp_path}/one", bad)
    with pytest.raises(ValueError, match="no tiers"):
        files.write_tiers(bars, f"{tmp_path}/x", ("tape",))
