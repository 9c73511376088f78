"""Performance metrics as Columns and aggregates over an equity curve, (symbol, ts, equity)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun 7.1.26, an approximation of erf to 1.5e-7: fixed values.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
EULER = 0.5772156649


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by built-in functions, to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    a = ERF
    erf = 1 - t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def normal_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_best(trials: int) -> float:
    """The Sharpe ratio that the best of so many worthless strategies is expected to have."""
    return 0.0 if trials < 2 else (1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e))


def deflated_pvalue(sharpe: Column, trials: int, n: Column, skew: Column, excess: Column) -> Column:
    """The chance that the best of ``trials`` worthless strategies does as well: low is good."""
    error = F.sqrt((1 + 0.5 * sharpe * sharpe - skew * sharpe + excess / 4 * sharpe * sharpe) / F.greatest(F.lit(1), n - 1))
    return F.when((n < 2) | (error < 1e-15), 1.0).otherwise(1 - normal_cdf((sharpe - expected_best(trials)) / error))


def deflated_probability(sharpe: Column, trials: Column, n: Column) -> Column:
    """The probability that a Sharpe ratio is above what ``trials`` trials give by chance: high is good.  Of normal returns."""
    spread = F.sqrt(2 * F.log(F.greatest(trials, F.lit(1.0 + 1e-9))))
    best = (1 - 0.5772) * spread + 0.5772 / spread
    error = F.sqrt((1 + 0.5 * sharpe * sharpe) / F.greatest(F.lit(1.0), n - 1))
    return F.when(n < 3, 0.0).otherwise(normal_cdf((sharpe - best) / error))


def curve(equity: DataFrame) -> DataFrame:
    """``equity`` with its return r, number rn, running peak and whether it is under it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return equity.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1).withColumn("rn", F.row_number().over(w)).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bundle(equity: DataFrame, trials: int = 1, rate: float = 0.03, per_year: float = 252.0) -> DataFrame:
    """All metrics of each symbol's curve in one row; two curves of windows, no driver."""
    c = curve(equity)
    root = math.sqrt(per_year)
    w = Window.partitionBy("symbol")
    c = c.withColumn("dd", F.col("equity") / F.col("peak") - 1)
    # where the curve is deepest, first of equals; the peak before it is the first bar at that height
    trough = c.withColumn("least", F.min("dd").over(w)).withColumn("trough", F.min(F.when(F.col("dd") == F.col("least"), F.col("rn"))).over(w))
    top = trough.withColumn("top", F.max(F.when(F.col("rn") == F.col("trough"), F.col("peak"))).over(w))
    marked = top.withColumn("g", F.sum((F.col("equity") >= F.col("peak")).cast("int")).over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    longest = marked.groupBy("symbol", "g").agg(F.count_if(F.col("equity") < F.col("peak")).alias("n")).groupBy("symbol").agg(F.max("n").alias("max_drawdown_duration"))
    tails = c.groupBy("symbol").agg(*[F.expr(f"percentile(r, {q}) AS q{k}") for q, k in ((0.05, "05"), (0.95, "95"), (0.01, "01"))])
    with_tails = marked.join(tails, "symbol")
    out = with_tails.groupBy("symbol").agg(
        F.count("*").alias("trading_days"), F.count("r").alias("n"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("final_value"), F.avg("r").alias("mean"),
        (F.stddev_samp("r") * root).alias("volatility"), F.expr("stddev_samp(CASE WHEN r < 0 THEN r END)").alias("down"), F.min("dd").alias("max_drawdown"),
        (F.min(F.when((F.col("rn") <= F.col("trough")) & (F.col("equity") == F.col("top")), F.col("rn"))) - 1).alias("max_drawdown_peak_idx"), (F.max("trough") - 1).alias("max_drawdown_trough_idx"),
        (F.coalesce(F.min(F.when((F.col("rn") > F.col("trough")) & (F.col("equity") >= F.col("top")), F.col("rn"))), F.count("*")) - 1).alias("max_drawdown_recovery_idx"),
        F.expr("sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END)").alias("omega_ratio"), F.expr("avg(CASE WHEN r > 0 THEN 1D WHEN r IS NOT NULL THEN 0D END)").alias("win_rate"),
        F.max("q05").alias("value_at_risk_95"), F.max("q01").alias("value_at_risk_99"), F.expr("avg(CASE WHEN r <= q05 THEN r END)").alias("cvar_95"), F.expr("avg(CASE WHEN r <= q01 THEN r END)").alias("cvar_99"),
        (F.max("q95") / F.abs(F.max("q05"))).alias("tail_ratio"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis_excess"),
    )
    out = out.withColumn("total_return", F.col("final_value") / F.col("first") - 1).withColumn("annual_return", F.pow(F.col("final_value") / F.col("first"), per_year / (F.col("trading_days") - 1)) - 1)
    out = out.withColumn("sharpe_ratio", (F.col("mean") * per_year - rate) / F.col("volatility")).withColumn("sortino_ratio", (F.col("mean") * per_year - rate) / (F.col("down") * root))
    out = out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.col("annual_return") / -F.col("max_drawdown")))
    out = out.withColumn("deflated_sharpe_pvalue", deflated_pvalue(F.col("sharpe_ratio"), trials, F.col("n"), F.col("skewness"), F.col("kurtosis_excess")))
    return out.join(longest, "symbol").drop("n", "first", "mean", "down")
