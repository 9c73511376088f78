"""Metrics, neighbourhoods, gates, files, streams and accounts, on small cases."""

import datetime as dt
import math
import shutil
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import ledger as L
from tickloom.operators import metrics as M
from tickloom.operators import research as R
from tickloom.operators import validation as V
from tickloom.sources import files
from tickloom.streaming import bars as S

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def some_bars(spark, n=60, symbols=("a", "b")):
    rng = np.random.default_rng(4)
    rows = []
    for s in symbols:
        c = 100 * np.cumprod(1 + rng.standard_normal(n) * 0.02)
        rows += [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(x), float(x * 1.01), float(x * 0.99), float(x), 1.0) for k, x in enumerate(c)]
    return spark.createDataFrame(rows, BARS)


def test_normal_distribution(spark):
    z = [-6.0, -1.96, -0.3, 0.0, 0.7, 2.5, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(M.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in z], abs=2e-7)


def test_deflated_sharpe_ratios(spark):
    row = spark.range(1).select(M.deflated_pvalue(F.lit(1.5), 100, F.lit(500), F.lit(-0.2), F.lit(1.0)).alias("p"), M.deflated_probability(F.lit(3.2), F.lit(100.0), F.lit(500.0)).alias("q")).first()
    nd = NormalDist()
    best = (1 - 0.5772156649) * nd.inv_cdf(1 - 1 / 100) + 0.5772156649 * nd.inv_cdf(1 - 1 / (100 * math.e))
    assert row.p == pytest.approx(1 - nd.cdf((1.5 - best) / math.sqrt((1 + 0.5 * 2.25 + 0.2 * 1.5 + 0.25 * 2.25) / 499)), abs=1e-6)
    root = math.sqrt(2 * math.log(100))
    assert row.q == pytest.approx(nd.cdf((3.2 - (0.4228 * root + 0.5772 / root)) / math.sqrt((1 + 0.5 * 3.2**2) / 499)), abs=1e-6)


def test_neighbours_move_one_parameter():
    assert V.neighbours([10.0, 0.5]) == [[11.0, 0.5], [9.0, 0.5], [10.0, 0.55], [10.0, 0.45]]
    assert V.neighbours([1.0, 0.0]) == []


def test_neighbourhood_by_hand(spark):
    b = some_bars(spark, 120, ("a",))
    chosen = spark.createDataFrame([("a", "MA", 3, [5.0, 20.0])], "symbol string, strategy string, combo_id int, params array<double>")
    got = V.neighbourhood(b, chosen).first()
    x = V.K.bars_from(np.array([r[2:6] for r in sorted(b.collect(), key=lambda r: r.ts)]))
    sharpe = V.sharpe_of(V.K.backtest("MA", x, [[5.0, 20.0], *V.neighbours([5.0, 20.0])], path=True)["curve"], 365.0)
    want = float(((sharpe[0] - sharpe[1:]) / max(abs(sharpe[0]), 1e-12) < 0.3).mean()) if sharpe[0] > 0 else 0.0
    assert (got.combo_id, got.sharpe, got.stability) == (3, pytest.approx(sharpe[0]), pytest.approx(want))


def test_gate_has_its_bounds(spark):
    cols = "symbol string, strategy string, sharpe double, dsr double, score double, ret double, stability double, noise_positive double, dd double"
    best = ("a", "MA", 9.0, 1.0, 100.0, 60.0, 1.0, 1.0, 0.0)
    worst = ("b", "MA", -1.0, 0.0, None, -5.0, 0.0, 0.0, 80.0)
    got = {r.symbol: r.gate for r in V.gate(spark.createDataFrame([best, worst], cols)).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.04)}


def test_bars_without_valid_prices_fail(spark):
    b = some_bars(spark, 5, ("a",))
    assert B.validate(b).count() == 5
    with pytest.raises(Exception, match="valid prices"):
        B.validate(b.withColumn("low", F.lit(0.0))).collect()


def test_defaults(spark):
    got = B.defaulted(spark.createDataFrame([("a", 2.0, None)], "symbol string, close double, open double")).first()
    assert (got.open, got.high, got.low, got.volume) == (2.0, 2.0, 2.0, float("inf"))


def test_rows_are_numbered_over_buckets(spark):
    rows = spark.range(100).selectExpr("id % 3 AS g", "id AS t")
    got = {(r.g, r.t): r.k for r in B.numbered(rows, ["g"], ["t"], F.expr("t DIV 7")).collect()}
    assert all(got[g, t] == t // 3 + 1 for g, t in got)


def test_database_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    b = some_bars(spark, 10).withColumn("ts", F.col("ts").cast("timestamp"))
    b.write.format("jdbc").options(url=url, dbtable="bars", driver=driver, createTableColumnTypes="symbol VARCHAR(40)").mode("overwrite").save()
    got = files.read_database(spark, url, "bars", "a", driver=driver)
    assert got.count() == 10 and {r[0] for r in got.select("symbol").collect()} == {"a"}


def test_files_come_back(spark, tmp_path):
    b = some_bars(spark)
    for ending, pack, read in ((".bin", files.to_binary, files.read_binary), (".arrow", files.to_arrow, files.read_arrow)):
        files.write_files(pack(b), f"{tmp_path}/x{ending}", ending)
        got = read(spark, f"{tmp_path}/x{ending}")
        assert sorted((r.symbol, r.ts) for r in got.collect()) == sorted((r.symbol, r.ts) for r in b.collect())
    files.write_csv(b, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", "2024-01-01 05:00:00", "2024-01-01 07:00:00").count() == 6


def test_a_batch_that_is_run_again_is_written_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(5).withColumnRenamed("id", "x").write.parquet(src)
    S.run_to(S.read(spark, src, "x long"), f"{tmp_path}/out", f"{tmp_path}/state")
    shutil.rmtree(f"{tmp_path}/state")  # as if the job had died before it noted the batch
    S.run_to(S.read(spark, src, "x long"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.x for r in S.result(spark, f"{tmp_path}/out", "x long").collect()) == [0, 1, 2, 3, 4]


def test_stops_fire_once(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, price double, entry double, seq long"
    prices = [(100.0, 100.0), (99.0, None), (94.0, None), (90.0, None), (50.0, 50.0), (56.0, None)]
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, k), p, e, k) for k, (p, e) in enumerate(prices)], schema).write.parquet(f"{tmp_path}/in")
    out = S.stops(S.read(spark, f"{tmp_path}/in", schema), 0.05, 0.1)
    S.run_to(out, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.price, r.reason) for r in S.result(spark, f"{tmp_path}/out", out.schema).collect()) == [(56.0, "target"), (94.0, "stop")]


def test_entries_of_an_account(spark):
    trades = [("buy", 2.0, 10.0), ("buy", 2.0, 20.0), ("sell", 1.0, 50.0), ("sell", 5.0, 30.0), ("buy", 2.0, 7.0)]
    rows = [("x", dt.datetime(2024, 1, 1), 1, k, side, q, p, 0.0) for k, (side, q, p) in enumerate(trades)]
    t = spark.createDataFrame(rows, "account string, ts timestamp, ok int, ln int, side string, shares double, price double, commission double")
    steps = [(r.position, r.entry) for k in range(1, 6) for r in L.replayed(t.filter(f"ln < {k}"), "account").collect()]
    assert steps == [(2.0, 10.0), (4.0, 15.0), (3.0, 15.0), (-2.0, 30.0), (0.0, 0.0)]


def test_orthogonal_features(spark):
    ics = spark.createDataFrame([("s", n, 0.0, 1.0, v, 0.0) for n, v in (("a", 0.9), ("b", 0.8), ("c", 0.5), ("d", 0.1))], "symbol string, name string, ic_mean double, ic_std double, icir double, ic_last double")
    m = spark.createDataFrame([("s", "a", "b", -0.9), ("s", "a", "c", 0.2), ("s", "b", "c", 0.9)], "symbol string, a string, b string, corr double")
    assert [r.name for r in R.orthogonal(ics, m, 0.7, 0.3).orderBy("place").collect()] == ["a", "c"]


def test_portfolio_of_unequal_lengths(spark):
    rows = [("a", k, 1.0 + k) for k in range(3)] + [("b", k, 1.0) for k in range(5)]
    got = V.K.portfolio(spark.createDataFrame(rows, "symbol string, bar int, equity double")).first()
    assert got.bars == 3 and got.ret == pytest.approx(100.0) and got.dd == 0.0
