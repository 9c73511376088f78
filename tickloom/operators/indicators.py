"""Window indicators as Columns over ordered bars; null until a window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def w():
    """Bars of a symbol in order; a function, as a window needs a running session."""
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int):
    return w().rowsBetween(1 - n, 0)


def prior(n: int):
    return w().rowsBetween(-n, -1)


def full(n: int, value: Column, skip: int = 0) -> Column:
    """The value once ``n`` bars (after ``skip``) are there."""
    return F.when(F.row_number().over(w()) >= n + skip, value)


def sma(c: str, n: int) -> Column:
    return full(n, F.avg(c).over(last(n)))


def std(c: str, n: int) -> Column:
    return full(n, F.stddev_pop(c).over(last(n)))


def zscore(c: str, n: int) -> Column:
    return full(n, F.try_divide(F.col(c) - F.avg(c).over(last(n)), F.nullif(F.stddev_pop(c).over(last(n)), F.lit(0.0))))


def simple_return(c: str = "close") -> Column:
    return F.coalesce(F.try_divide(F.col(c), F.lag(c).over(w())) - 1, F.lit(0.0))


def true_range() -> Column:
    before = F.lag("close").over(w())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def channel(n: int) -> tuple[Column, Column]:
    return full(n, F.max("high").over(last(n))), full(n, F.min("low").over(last(n)))


def williams_r(n: int) -> Column:
    hh, ll = F.max("high").over(last(n)), F.min("low").over(last(n))
    return full(n, F.when(hh == ll, F.lit(-50.0)).otherwise(-100 * F.try_divide(hh - F.col("close"), hh - ll)))


def stochastic(b: DataFrame, n: int, d: int) -> DataFrame:
    hh, ll = F.max("high").over(last(n)), F.min("low").over(last(n))
    b = b.withColumn("stoch_k", full(n, F.when(hh == ll, F.lit(50.0)).otherwise(100 * F.try_divide(F.col("close") - ll, hh - ll))))
    return b.withColumn("stoch_d", full(n + d - 1, F.avg("stoch_k").over(last(d))))


def cci(b: DataFrame, n: int) -> DataFrame:
    """(tp - mean) / (0.015 mean absolute deviation); 0 without deviation."""
    b = b.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("tps", F.collect_list("tp").over(last(n))).withColumn("m", F.avg("tp").over(last(n)))
    mad = F.aggregate("tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m"))) / n
    return b.withColumn("mad", mad).withColumn("cci", full(n, F.when(F.col("mad") < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.col("tp") - F.col("m"), 0.015 * F.col("mad"))))).drop("tps", "m", "mad", "tp")


def ofi(n: int) -> Column:
    """Order-flow imbalance: volume by where the close lies in the bar; 0 for a flat bar."""
    flow = F.when(F.col("high") == F.col("low"), F.lit(0.0)).otherwise(F.col("volume") * F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")))
    return full(n, F.sum(flow).over(last(n)))


def change(c: str, k: int) -> Column:
    before = F.lag(c, k).over(w())
    return (F.col(c) - before) / (F.abs(before) + 1e-10)


def trade_imbalance(b: DataFrame, n: int) -> DataFrame:
    """Signed volume by the tick rule over all volume."""
    side = F.signum(F.col("close") - F.lag("close").over(w()))
    b = b.withColumn("signed", F.coalesce(side, F.lit(0.0)) * F.col("volume"))
    return b.withColumn("imbalance", full(n, F.coalesce(F.try_divide(F.sum("signed").over(last(n)), F.nullif(F.sum("volume").over(last(n)), F.lit(0.0))), F.lit(0.0)))).drop("signed")


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) with the limits of IEEE arithmetic: minus infinity for a zero ``a``, infinity for a zero ``b``, NaN for a negative ratio."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = F.try_divide(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.when(a > 0, inf).otherwise(nan)).when(a == 0, -inf).when(ratio < 0, nan).otherwise(F.log(ratio))


def yang_zhang(b: DataFrame, n: int) -> DataFrame:
    before = F.lag("close").over(w())
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    b = b.withColumn("co", log_ratio(o, before)).withColumn("oc", log_ratio(c, o))
    b = b.withColumn("rs", log_ratio(h, c) * log_ratio(h, o) + log_ratio(l, c) * log_ratio(l, o))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    v = F.var_pop("co").over(last(n)) + k * F.var_pop("oc").over(last(n)) + (1 - k) * F.avg("rs").over(last(n))
    return b.withColumn("yang_zhang", full(n, F.sqrt(F.greatest(v, F.lit(0.0))), 1)).drop("co", "oc", "rs")


def vol_of_vol(b: DataFrame, n: int, m: int) -> DataFrame:
    b = b.withColumn("lr", F.log(F.col("close") / F.lag("close").over(w()))).withColumn("v", full(n, F.stddev_pop("lr").over(last(n)), 1))
    return b.withColumn("vov", full(n + m - 1, F.stddev_pop("v").over(last(m)), 1)).drop("lr", "v")


def vol_ratio(b: DataFrame, fast: int, slow: int) -> DataFrame:
    b = b.withColumn("r", simple_return())
    return b.withColumn("vol_ratio", full(slow, F.try_divide(F.stddev_pop("r").over(last(fast)), F.nullif(F.stddev_pop("r").over(last(slow)), F.lit(0.0))), 1)).drop("r")


def drift_ratio(b: DataFrame, n: int) -> DataFrame:
    """Share of up bars among the last ``n``."""
    b = b.withColumn("up", (F.col("close") > F.lag("close").over(w())).cast("double"))
    return b.withColumn("up_ratio", full(n, F.avg("up").over(last(n)), 1)).drop("up")


def pair_window(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Rolling beta, correlation and lead-lag of two symbols on their common times.  (ts, beta, corr, lead_lag)."""
    own = Window.partitionBy("pair").orderBy("ts")
    x = a.select("ts", F.col("close").alias("ca")).join(b.select("ts", F.col("close").alias("cb")), "ts").withColumn("pair", F.lit(1))
    x = x.withColumn("ra", F.coalesce(F.col("ca") / F.lag("ca").over(own) - 1, F.lit(0.0))).withColumn("rb", F.coalesce(F.col("cb") / F.lag("cb").over(own) - 1, F.lit(0.0)))
    f = own.rowsBetween(1 - n, 0)
    g = own.rowsBetween(2 - n, 0)
    x = x.withColumn("ab", F.lag("ra").over(own) * F.col("rb")).withColumn("ba", F.lag("rb").over(own) * F.col("ra"))
    some = F.row_number().over(own) >= n
    var = F.var_pop("rb").over(f)
    return x.select("ts", F.when(some & (var > 1e-20), F.covar_pop("ra", "rb").over(f) / var).alias("beta"), F.when(some & (var > 1e-20) & (F.var_pop("ra").over(f) > 1e-20), F.corr("ra", "rb").over(f)).alias("corr"), F.when(some, F.abs(F.try_divide(F.sum("ab").over(g), F.nullif(F.sum("ba").over(g), F.lit(0.0))))).alias("lead_lag"))


def dual_thrust(n: int, k: float) -> tuple[Column, Column]:
    """Bands around the open from the range of the prior ``n`` bars."""
    p = prior(n)
    span = F.greatest(F.max("high").over(p) - F.min("close").over(p), F.max("close").over(p) - F.min("low").over(p))
    return full(n, F.col("open") + k * span, 1), full(n, F.col("open") - k * span, 1)
