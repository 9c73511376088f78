"""Research tables: strategy library, parameter history, presets, keyword scores, rank correlations of features."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of each bar interval, from fine to coarse.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
#: Words that count one and a half point, and those that tell how hard a method is, first match first.
HIGH_VALUE = ["backtest", "profit", "sharpe", "alpha", "return", "momentum", "mean reversion", "trading signal", "portfolio"]
MEDIUM_VALUE = ["machine learning", "deep learning", "neural", "reinforcement", "prediction", "forecast"]
COMPLEXITY = [
    ("LOW", ["moving average", "momentum", "rsi", "macd", "bollinger", "breakout", "trend", "mean reversion"]),
    ("HIGH", ["transformer", "attention", "reinforcement learning", "neural network", "deep learning", "gan", "lstm"]),
    ("MEDIUM", ["regression", "feature", "ensemble", "random forest", "gradient boosting", "bayesian"]),
]
SPARKS = "▁▂▃▄▅▆▇█"


def doubles(sql: str) -> str:
    """Decimal numbers of an expression as doubles, which Spark's SQL otherwise takes for decimals."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", sql)


def exponents(sql: str) -> str:
    """The same for DuckDB."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


def intervals(spark: SparkSession) -> DataFrame:
    rows = [(n, k, x, 86400 // x, 365 * 86400 // x) for k, (n, x) in enumerate(INTERVALS.items())]
    return spark.createDataFrame(rows, "name string, rank int, seconds int, bars_per_day int, bars_per_year int")


def presets(spark: SparkSession) -> DataFrame:
    """Costs of three kinds of market."""
    rows = [("conservative", 0.0015, 5.0, 0.0, 0.0), ("crypto", 0.0004, 3.0, 0.0003, 0.0), ("equity", 0.0005, 5.0, 0.0, 0.03)]
    return spark.createDataFrame(rows, "name string, commission double, slippage_bps double, daily_funding double, borrow_annual double")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kernel, symbol, gate, status): a strategy library derived from the customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    status = F.when(F.col("c_custkey") % 3 == 0, "LIVE").when(F.col("c_custkey") % 3 == 1, "PAPER").otherwise("RETIRED")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kernel"), F.col("c_nationkey").alias("symbol"), (F.col("c_acctbal") / 10000).alias("gate"), status.alias("status"))


def champions(lib: DataFrame) -> DataFrame:
    """(kernel, symbol, champion, champion_gate): the first live strategy of each."""
    live = lib.filter("status = 'LIVE'").groupBy("kernel", "symbol").agg(F.min_by(F.struct("id", "gate"), "id").alias("x"))
    return live.select("kernel", "symbol", F.col("x.id").alias("champion"), F.col("x.gate").alias("champion_gate"))


def promotions(lib: DataFrame, lead: float = 0.05) -> DataFrame:
    """(kernel, symbol, challenger, champion, delta): the first paper strategy whose gate is ``lead`` above the champion's."""
    able = lib.filter("status = 'PAPER'").join(champions(lib), ["kernel", "symbol"]).filter(F.col("gate") >= F.col("champion_gate") + lead)
    first = able.groupBy("kernel", "symbol", "champion", "champion_gate").agg(F.min_by(F.struct("id", "gate"), "id").alias("x"))
    return first.select("kernel", "symbol", F.col("x.id").alias("challenger"), "champion", (F.col("x.gate") - F.col("champion_gate")).alias("delta"))


def promoted(lib: DataFrame) -> DataFrame:
    """(id, status) after all promotions: challengers live, champions that they replace retired."""
    p = promotions(lib).select("kernel", "symbol", "challenger", "champion")
    now = F.when(F.col("id") == F.col("challenger"), "LIVE").when(F.col("id") == F.col("champion"), "RETIRED").otherwise(F.col("status"))
    return lib.join(p, ["kernel", "symbol"], "left").select("id", now.alias("status"))


def newest(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def blended(history: DataFrame, keys: list[str], order: Column, params: dict[str, bool], back: int, decay: float = 0.9) -> DataFrame:
    """Parameters blended over a history with ``sharpe``: the newest counts as new evidence, the ``back`` ones before it decay with age.

    ``params`` says of each whether it is a whole number.
    """
    rows = history.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).filter(F.col("_i") <= back)
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(F.pow(F.lit(decay), F.col("_i") - 1)) * (1 + F.greatest(F.col("sharpe"), F.lit(0.0)))
    mean = {p: F.sum(F.col(p) * weight) / F.sum(weight) for p in params}
    return rows.groupBy(*keys).agg(*[(F.round(mean[p]).cast("long") if whole else F.round(mean[p], 6)).alias(p) for p, whole in params.items()])


def signals(df: DataFrame) -> DataFrame:
    """Rows with an action among buy, sell and cancel, in lower case."""
    return df.withColumn("action", F.lower("action")).filter(F.col("action").isin("buy", "sell", "cancel"))


def scored(df: DataFrame, text: str) -> DataFrame:
    """``df`` with score (1 to 5, by words that ``text`` contains) and level (by the first list with a word in it)."""

    def has(words):
        return [F.col(text).contains(w) for w in words]

    points = sum([F.when(x, 1.0).otherwise(0.0) for x in has(HIGH_VALUE)] + [F.when(x, 0.5).otherwise(0.0) for x in has(MEDIUM_VALUE)], F.lit(1.0))
    level = F.lit("MEDIUM")
    for name, words in reversed(COMPLEXITY):
        any_of = has(words)[0]
        for x in has(words)[1:]:
            any_of = any_of | x
        level = F.when(any_of, name).otherwise(level)
    return df.withColumn("score", F.least(F.lit(5), F.floor(points)).cast("int")).withColumn("level", level)


def sparklines(df: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """(symbol, line, arrow): the last ``width`` values as glyphs between their least and greatest, and where they go."""
    last = newest(df, ["symbol"], [F.desc(order)], width)
    a = last.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-12
    glyph = F.transform("v", lambda x: F.substring(F.lit(SPARKS), F.when(flat, 4).otherwise(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 7), F.lit(7)).cast("int") + 1), F.lit(1)))
    delta = F.element_at("v", -1) - F.element_at("v", 1)
    return a.select("symbol", F.array_join(glyph, "").alias("line"), F.when(F.abs(delta) < 0.01, "→").when(delta > 0, "↗").otherwise("↘").alias("arrow"))


def spearman_matrix(features: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, a, b, corr) of all pairs of features, by ranks over all bars; ties rank in order of time.  One row of ranks a bar, no join."""
    w = {k: Window.partitionBy("symbol").orderBy(k, "ts") for k in names}
    ranks = features.select("symbol", *[F.row_number().over(w[k]).alias(k) for k in names])
    pairs = [(a, b) for a in names for b in names if a < b]
    wide = ranks.groupBy("symbol").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")
    return wide.select("symbol", entries).select("symbol", "x.*")


def ordinal(x: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, ties in order."""
    out = np.empty(x.shape)
    np.put_along_axis(out, np.argsort(x, axis=-1, kind="stable"), np.arange(x.shape[-1], dtype=float), -1)
    return out


def rolling_ic(features: DataFrame, names: list[str], forward: str, n: int) -> DataFrame:
    """(symbol, name, ic_mean, ic_std, icir, ic_last): rank correlation with the forward return over the ``n`` bars before each bar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        rows = []
        if len(pdf) >= n + 3:
            windows = np.lib.stride_tricks.sliding_window_view
            b = ordinal(windows(pdf[forward].to_numpy(float), n)[:-1])
            b = b - b.mean(1, keepdims=True)
            for name in names:
                a = ordinal(windows(pdf[name].to_numpy(float), n)[:-1])
                a = a - a.mean(1, keepdims=True)
                ic = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                sd = float(ic.std())
                rows.append((pdf["symbol"].iloc[0], name, float(ic.mean()), sd, float(ic.mean()) / sd if sd > 1e-10 else 0.0, float(ic[-1])))
        return pd.DataFrame(rows, columns=["symbol", "name", "ic_mean", "ic_std", "icir", "ic_last"])

    return features.groupBy("symbol").applyInPandas(run, "symbol string, name string, ic_mean double, ic_std double, icir double, ic_last double")


def orthogonal(ics: DataFrame, matrix: DataFrame, most: float = 0.7, least: float = 0.3) -> DataFrame:
    """(symbol, place, name): features by falling icir of ``least`` at least, each unless it goes along with one taken before; one row a feature is all that a task sees."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        corr = {frozenset((x.a, x.b)): abs(x.corr) for x in b.itertuples()}
        taken: list[str] = []
        for x in a[a["icir"] >= least].sort_values(["icir", "name"], ascending=[False, True]).itertuples():
            if all(not corr.get(frozenset((x.name, y)), 0.0) > most for y in taken):
                taken.append(x.name)
        return pd.DataFrame([(key[0], k, name) for k, name in enumerate(taken)], columns=["symbol", "place", "name"])

    return ics.groupBy("symbol").cogroup(matrix.groupBy("symbol")).applyInPandas(run, "symbol string, place int, name string")


def split_scores(trades: DataFrame, keys: list[str], groups: int = 6) -> DataFrame:
    """(keys, cpcv_score, positive): mean profit of a trade over all splits that test two of ``groups`` parts of the time, and the share of splits above 0.

    ``trades`` has the keys, ``sec`` and ``pnl``.  Profits are summed by part first, so a split adds
    two rows a key.  Keys without a trade in each part are not tested and not returned.
    """
    lo, hi = trades.agg(F.min("sec"), F.max("sec")).first()
    part = F.expr(f"(sec - {lo or 0}) * {groups} DIV {(hi or 0) - (lo or 0) + 1}")
    sums = trades.filter("sec IS NOT NULL AND pnl IS NOT NULL").groupBy(*keys, part.alias("part")).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))
    others = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda o: o != F.col("part"))
    split = F.explode(F.transform(others, lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))).alias("split")
    scores = sums.select(*keys, "part", "pnl", "n", split).groupBy(*keys, "split").agg((F.sum("pnl") / F.sum("n")).alias("score"), F.count("*").alias("parts"))
    tested = scores.groupBy(*keys).agg(F.avg("score").alias("cpcv_score"), F.avg(F.expr("CAST(score > 0 AS INT)")).alias("positive"), F.min("parts").alias("least"), F.count("*").alias("splits"))
    return tested.filter((F.col("least") == 2) & (F.col("splits") == groups * (groups - 1) // 2)).drop("least", "splits")


def tagged(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``cpcv_score`` and whether it is above 0; rows without a score are not validated.  Null keys meet null keys."""
    right = scores.select(*[F.col(k).alias(f"__{k}") for k in keys], "cpcv_score")
    same = [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = rows.join(right, same, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumn("cpcv_validated", F.coalesce(F.col("cpcv_score") > 0, F.lit(False)))
