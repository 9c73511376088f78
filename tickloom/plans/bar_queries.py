"""Queries over bars and window indicators, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import indicators as I

from .oracle import DAILY, W, bars_cte, frame, windowed

QUERIES: dict = {}
SQL: dict = {}
OHLCV = ["open", "high", "low", "close", "volume"]


def rounding(c: Column, digits: int) -> Column:
    """A double to ``digits`` places by rounding its product, as the SQL does: the decimal digits of a double say otherwise at some ties."""
    places = 10.0**digits
    return F.when(F.abs(c) < 1e300 / places, F.round(c * places, 0) / places).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that sums in another order compare equal."""
    return df.select(*[(rounding(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shared(s: SparkSession) -> str:
    """A fresh path in the folder that all executors share; only a local master may do without the setting."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if not root and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='tickloom-')).rstrip('/')}/core-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def indicator(name: str, build, sql: str) -> None:
    """A query that adds indicators to 4-hour bars; ``build`` takes bars and gives columns or a frame with them."""

    def fn(spark, d):
        b = B.bars_of(spark, d)
        got = build(b)
        if isinstance(got, dict):
            return rounded(b.select("symbol", "ts", *[v.alias(k) for k, v in got.items()]))
        return rounded(got.drop(*OHLCV))

    query(name, sql)(fn)


def guard(n: int, expr: str, name: str) -> str:
    return f"round(CASE WHEN row_number() OVER w >= {n} THEN {expr} END, 6) AS {name}"


R4 = ", ".join(f"round({c}, 6) AS {c}" for c in OHLCV)
for every in ("1 hour", "4 hours", "1 day"):
    query("bars_" + every.replace(" ", "").replace("hours", "h").replace("hour", "h").replace("day", "d"), f"WITH {bars_cte(every)} SELECT symbol, ts::TIMESTAMP AS ts, {R4} FROM bars")(lambda s, d, every=every: rounded(B.bars_of(s, d, every)))
query("bars_daily_orders", f"WITH {DAILY} SELECT symbol, ts, {R4} FROM daily")(lambda s, d: rounded(B.daily_bars(s, d)))
query("resample_4h", f"""WITH {bars_cte('1 hour', 'h')}, bars AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM h GROUP BY 1, 2)
  SELECT symbol, ts::TIMESTAMP AS ts, {R4} FROM bars""")(lambda s, d: rounded(B.resample(B.bars_of(s, d, "1 hour"), "4 hours")))
query("resample_n", f"""WITH {bars_cte()}, g AS (SELECT *, (row_number() OVER w - 1) // 6 AS g FROM bars WINDOW {W}),
  r AS (SELECT symbol, g, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM g GROUP BY 1, 2)
  SELECT symbol, ts, {R4} FROM r WHERE n = 6""")(lambda s, d: rounded(B.resample_count(B.bars_of(s, d), 6)))
query("scan_range", f"WITH {bars_cte('1 hour')} SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")(
    lambda s, d: rounded(B.bars_of(s, d, "1 hour").filter("ts BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-12'").select("symbol", "ts", "close")))
query("clean_bars", f"WITH {bars_cte()} SELECT symbol, ts, {R4} FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0")(lambda s, d: rounded(B.clean(B.bars_of(s, d))))
query("distinct_symbols", "SELECT DISTINCT event_type AS symbol FROM events")(lambda s, d: B.ticks(s, d).select("symbol").distinct())
query("max_date", "SELECT event_type AS symbol, max(ts) AS max_ts, count(*) AS n FROM events GROUP BY 1")(lambda s, d: B.ticks(s, d).groupBy("symbol").agg(F.max("ts").alias("max_ts"), F.count("*").alias("n")))
query("min_bars_symbols", f"WITH {bars_cte()} SELECT b.symbol, b.ts, round(close, 6) AS close FROM bars b WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 100)")(
    lambda s, d: rounded((b := B.bars_of(s, d)).join(b.groupBy("symbol").count().filter("count >= 100"), "symbol", "left_semi").select("symbol", "ts", "close")))


def _two_batches(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return o.filter("seq % 3 <> 0").withColumn("batch", F.lit(1)).unionByName(o.filter("seq % 2 = 0").withColumn("batch", F.lit(2)).withColumn("price", F.col("price") + 1))


_TB = "b AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, o_totalprice AS price, o_orderkey AS seq, 1 AS batch FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderpriority, o_orderdate::DATE, o_totalprice + 1, o_orderkey, 2 FROM orders WHERE o_orderkey % 2 = 0)"
for name, way in (("dedupe_last", "DESC"), ("merge_first", "ASC")):
    query(name, f"WITH {_TB} SELECT symbol, day, round(price, 6) AS price, seq, batch FROM b QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY batch {way}, seq {way}) = 1")(
        lambda s, d, way=way: rounded(B.keep_one(_two_batches(s, d), ["symbol", "day"], [getattr(F.col(c), way.lower())() for c in ("batch", "seq")])))
query("month_last_change", f"""WITH {DAILY}, m AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, arg_max(close, ts) AS close FROM daily GROUP BY 1, 2)
  SELECT symbol, month, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1, 6) AS change FROM m""")(
    lambda s, d: rounded(B.daily_bars(s, d).groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.max_by("close", "ts").alias("close")).withColumn("change", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("month")) - 1)))
query("month_pivot", f"WITH {DAILY} SELECT year(ts)::INT AS year, " + ", ".join(f"round(sum(volume) FILTER (month(ts) = {m}), 6) AS m{m}" for m in range(1, 13)) + " FROM daily GROUP BY 1")(
    lambda s, d: rounded(B.daily_bars(s, d).select(F.year("ts").alias("year"), F.concat(F.lit("m"), F.month("ts")).alias("month"), "volume").groupBy("year").pivot("month", [f"m{m}" for m in range(1, 13)]).agg(F.sum("volume"))))
query("fill_forward_grid", f"""WITH {bars_cte()}, {bars_cte('1 hour', 'h')} SELECT h.symbol, h.ts, round(b.close, 6) AS close_4h FROM h ASOF LEFT JOIN bars b ON h.symbol = b.symbol AND h.ts >= b.ts""")(
    lambda s, d: rounded(asof(B.bars_of(s, d, "1 hour").select("symbol", "ts"), B.bars_of(s, d).select("symbol", "ts", F.col("close").alias("close_4h")), "close_4h")))


def asof(left: DataFrame, right: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Backward as-of join by union and forward fill: one sort per key, no range blow-up."""
    both = left.withColumn(value, F.lit(None).cast("double")).withColumn("_r", F.lit(1)).unionByName(right.select(key, "ts", value).withColumn("_r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_r = 1").drop("_r")


indicator("sma", lambda b: {"ma5": I.sma("close", 5), "ma20": I.sma("close", 20)}, windowed(f"{guard(5, f'avg(close) OVER {frame(5)}', 'ma5')}, {guard(20, f'avg(close) OVER {frame(20)}', 'ma20')}"))
indicator("rolling_std", lambda b: {"std20": I.std("close", 20)}, windowed(guard(20, f"stddev_pop(close) OVER {frame(20)}", "std20")))
indicator("bollinger", lambda b: {"mid": I.sma("close", 20), "upper": I.sma("close", 20) + 2 * I.std("close", 20), "lower": I.sma("close", 20) - 2 * I.std("close", 20)},
    windowed(", ".join([guard(20, f"avg(close) OVER {frame(20)}", "mid"), guard(20, f"avg(close) OVER {frame(20)} + 2 * stddev_pop(close) OVER {frame(20)}", "upper"), guard(20, f"avg(close) OVER {frame(20)} - 2 * stddev_pop(close) OVER {frame(20)}", "lower")])))
indicator("zscore", lambda b: {"z": I.zscore("close", 20)}, windowed(guard(20, f"(close - avg(close) OVER {frame(20)}) / nullif(stddev_pop(close) OVER {frame(20)}, 0)", "z")))
_TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"
indicator("true_range", lambda b: {"tr": I.true_range()}, windowed(f"round({_TR}, 6) AS tr"))
indicator("atr_sma", lambda b: b.withColumn("tr", I.true_range()).withColumn("atr", I.sma("tr", 14)).drop("tr"), f"WITH {bars_cte()}, t AS (SELECT *, {_TR} AS tr FROM bars WINDOW {W}) SELECT symbol, ts, {guard(14, f'avg(tr) OVER {frame(14)}', 'atr')} FROM t WINDOW {W}")
indicator("donchian", lambda b: dict(zip(("hh", "ll"), I.channel(20), strict=True)), windowed(f"{guard(20, f'max(high) OVER {frame(20)}', 'hh')}, {guard(20, f'min(low) OVER {frame(20)}', 'll')}"))
_HL = f"max(high) OVER {frame(14)}", f"min(low) OVER {frame(14)}"
indicator("willr", lambda b: {"willr": I.williams_r(14)}, windowed(guard(14, f"CASE WHEN {_HL[0]} = {_HL[1]} THEN -50 ELSE -100 * ({_HL[0]} - close) / ({_HL[0]} - {_HL[1]}) END", "willr")))
indicator("stoch", lambda b: I.stochastic(b, 14, 3), f"WITH {bars_cte()}, k AS (SELECT *, CASE WHEN row_number() OVER w >= 14 THEN CASE WHEN {_HL[0]} = {_HL[1]} THEN 50 ELSE 100 * (close - {_HL[1]}) / ({_HL[0]} - {_HL[1]}) END END AS k FROM bars WINDOW {W}) SELECT symbol, ts, round(k, 6) AS stoch_k, {guard(16, f'avg(k) OVER {frame(3)}', 'stoch_d')} FROM k WINDOW {W}")
indicator("cci", lambda b: I.cci(b, 20), f"""WITH {bars_cte()}, t AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER w AS rn FROM bars WINDOW {W}),
  m AS (SELECT *, avg(tp) OVER {frame(20)} AS m, list(tp) OVER {frame(20)} AS l FROM t), x AS (SELECT *, list_sum(list_transform(l, lambda v: abs(v - m))) / 20 AS mad FROM m)
  SELECT symbol, ts, round(CASE WHEN rn >= 20 THEN CASE WHEN mad < 1e-12 THEN 0 ELSE (tp - m) / (0.015 * mad) END END, 6) AS cci FROM x""")
_FLOW = "CASE WHEN high = low THEN 0 ELSE volume * (2 * close - high - low) / (high - low) END"
indicator("ofi", lambda b: {"ofi": I.ofi(10)}, windowed(guard(10, f"sum({_FLOW}) OVER {frame(10)}", "ofi")))
indicator("ofi_roc", lambda b: b.withColumn("ofi", F.round(I.ofi(10), 6)).withColumn("roc", I.change("ofi", 5)).drop("ofi"), f"WITH {bars_cte()}, o AS (SELECT *, CASE WHEN row_number() OVER w >= 10 THEN round(sum({_FLOW}) OVER {frame(10)}, 6) END AS x FROM bars WINDOW {W}) SELECT symbol, ts, round((x - lag(x, 5) OVER w) / (abs(lag(x, 5) OVER w) + 1e-10), 6) AS roc FROM o WINDOW {W}")
indicator("imbalance", lambda b: I.trade_imbalance(b, 20), f"WITH {bars_cte()}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS sv FROM bars WINDOW {W}) SELECT symbol, ts, {guard(20, f'coalesce(sum(sv) OVER {frame(20)} / nullif(sum(volume) OVER {frame(20)}, 0), 0)', 'imbalance')} FROM s WINDOW {W}")
_K = 0.34 / (1.34 + 21 / 19)
indicator("yang_zhang", lambda b: I.yang_zhang(b, 20), f"""WITH {bars_cte()}, l AS (SELECT *, ln(open / lag(close) OVER w) AS co, ln(close / open) AS oc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars WINDOW {W})
  SELECT symbol, ts, {guard(21, f'sqrt(greatest(var_pop(co) OVER {frame(20)} + {_K!r} * var_pop(oc) OVER {frame(20)} + {1 - _K!r} * avg(rs) OVER {frame(20)}, 0))', 'yang_zhang')} FROM l WINDOW {W}""")
indicator("vov", lambda b: I.vol_of_vol(b, 10, 10), f"WITH {bars_cte()}, l AS (SELECT *, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW {W}), v AS (SELECT *, CASE WHEN row_number() OVER w >= 11 THEN stddev_pop(lr) OVER {frame(10)} END AS v FROM l WINDOW {W}) SELECT symbol, ts, {guard(20, f'stddev_pop(v) OVER {frame(10)}', 'vov')} FROM v WINDOW {W}")
indicator("vol_ratio", lambda b: I.vol_ratio(b, 5, 20), f"WITH {bars_cte()}, r AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM bars WINDOW {W}) SELECT symbol, ts, {guard(21, f'stddev_pop(r) OVER {frame(5)} / nullif(stddev_pop(r) OVER {frame(20)}, 0)', 'vol_ratio')} FROM r WINDOW {W}")
indicator("drift_ratio", lambda b: I.drift_ratio(b, 10), f"WITH {bars_cte()}, u AS (SELECT *, (close > lag(close) OVER w)::INT::DOUBLE AS up FROM bars WINDOW {W}) SELECT symbol, ts, {guard(11, f'avg(up) OVER {frame(10)}', 'up_ratio')} FROM u WINDOW {W}")
indicator("returns", lambda b: {"ret": I.simple_return(), "log_ret": F.log(F.col("close") / F.lag("close").over(I.w()))}, windowed("round(coalesce(close / lag(close) OVER w - 1, 0), 6) AS ret, round(ln(close / lag(close) OVER w), 6) AS log_ret"))
_P = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_SPAN = f"greatest(max(high) OVER {_P} - min(close) OVER {_P}, max(close) OVER {_P} - min(low) OVER {_P})"
indicator("dual_thrust", lambda b: dict(zip(("upper", "lower"), I.dual_thrust(5, 0.5), strict=True)), windowed(f"{guard(6, f'open + 0.5 * {_SPAN}', 'upper')}, {guard(6, f'open - 0.5 * {_SPAN}', 'lower')}"))
indicator("breakout_prior_channel", lambda b: {"breakout": F.when(F.row_number().over(I.w()) > 20, F.when(F.col("close") > F.max("high").over(I.prior(20)), 1).when(F.col("close") < F.min("low").over(I.prior(20)), -1).otherwise(0))},
    windowed("CASE WHEN row_number() OVER w > 20 THEN CASE WHEN close > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1 WHEN close < min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN -1 ELSE 0 END END AS breakout"))
indicator("horizon_returns", lambda b: {f"r{n}": F.col("close") / F.lag("close", n).over(I.w()) - 1 for n in (1, 5, 21)} | {"from_high": F.col("close") / F.max("high").over(I.w().rowsBetween(Window.unboundedPreceding, 0)) - 1},
    windowed(", ".join(f"round(close / lag(close, {n}) OVER w - 1, 6) AS r{n}" for n in (1, 5, 21)) + ", round(close / max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 6) AS from_high"))
_PAIR = f"""WITH {bars_cte()}, j AS (SELECT a.ts, a.close AS ca, b.close AS cb FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'view' AND b.symbol = 'click'),
  r AS (SELECT ts, coalesce(ca / lag(ca) OVER (ORDER BY ts) - 1, 0) AS ra, coalesce(cb / lag(cb) OVER (ORDER BY ts) - 1, 0) AS rb, row_number() OVER (ORDER BY ts) AS rn FROM j),
  p AS (SELECT *, lag(ra) OVER (ORDER BY ts) * rb AS ab, lag(rb) OVER (ORDER BY ts) * ra AS ba FROM r)
  SELECT ts, round(CASE WHEN rn >= 20 AND var_pop(rb) OVER f > 1e-20 THEN covar_pop(ra, rb) OVER f / var_pop(rb) OVER f END, 6) AS beta,
    round(CASE WHEN rn >= 20 AND var_pop(rb) OVER f > 1e-20 AND var_pop(ra) OVER f > 1e-20 THEN corr(ra, rb) OVER f END, 6) AS corr,
    round(CASE WHEN rn >= 20 THEN abs(sum(ab) OVER g / nullif(sum(ba) OVER g, 0)) END, 6) AS lead_lag
  FROM p WINDOW f AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (ORDER BY ts ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)"""
query("pair_beta_corr_leadlag", _PAIR)(lambda s, d: rounded(I.pair_window((b := B.bars_of(s, d)).filter("symbol = 'view'"), b.filter("symbol = 'click'"), 20)))
_X = "CASE WHEN rn > 20 AND ps <= pl AND ma_s > ma_l THEN 1 WHEN rn > 20 AND ps >= pl AND ma_s < ma_l THEN -1 ELSE 0 END"
SQL["ma_cross_signal"] = f"""WITH {bars_cte()}, i AS (SELECT symbol, ts, close, row_number() OVER w AS rn, avg(close) OVER {frame(5)} AS ma_s, avg(close) OVER {frame(20)} AS ma_l, lead(open) OVER w AS next_open FROM bars WINDOW {W}),
  p AS (SELECT *, lag(ma_s) OVER w AS ps, lag(ma_l) OVER w AS pl FROM i WINDOW {W})
  SELECT symbol, ts, round(close, 6) AS close, round(ma_s, 6) AS ma_s, round(ma_l, 6) AS ma_l, round(next_open, 6) AS next_open, {_X} AS signal FROM p WHERE rn >= 20"""


@query("ma_cross_signal")
def ma_cross_signal(s, d):
    i = B.bars_of(s, d).select("symbol", "ts", "close", F.row_number().over(I.w()).alias("rn"), F.avg("close").over(I.last(5)).alias("ma_s"), F.avg("close").over(I.last(20)).alias("ma_l"), F.lead("open").over(I.w()).alias("next_open"))
    p = i.withColumn("ps", F.lag("ma_s").over(I.w())).withColumn("pl", F.lag("ma_l").over(I.w()))
    return rounded(p.filter("rn >= 20").select("symbol", "ts", "close", "ma_s", "ma_l", "next_open", F.expr(_X).alias("signal")))


query("data_quality", f"""WITH {bars_cte()}, x AS (SELECT *, lag(close) OVER w AS pc, lag(ts) OVER w AS pt FROM bars WINDOW {W})
  SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count_if(close IS NULL) AS null_closes, count_if(close <= 0) AS bad_closes, count_if(high < low) AS crossed, count_if(abs(close / pc - 1) > 0.5) AS jumps,
  count_if(date_diff('second', pt, ts) > 14400) AS gaps, count_if(open > high OR open < low OR close > high OR close < low) AS outside, round(avg(close), 6) AS mean_close FROM x GROUP BY 1""")(
    lambda s, d: rounded(B.bars_of(s, d).withColumn("pc", F.lag("close").over(I.w())).withColumn("pt", F.lag("ts").over(I.w())).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("close").isNull()).alias("null_closes"), F.count_if(F.expr("close <= 0")).alias("bad_closes"), F.count_if(F.expr("high < low")).alias("crossed"), F.count_if(F.expr("abs(close / pc - 1) > 0.5")).alias("jumps"),
        F.count_if(F.expr("timestampdiff(SECOND, pt, ts) > 14400")).alias("gaps"), F.count_if(F.expr("open > high OR open < low OR close > high OR close < low")).alias("outside"), F.avg("close").alias("mean_close"))))
