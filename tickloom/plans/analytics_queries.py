"""Joins, metrics, journals, risk, retrieval and strategy queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.operators import affine
from tickloom.operators import bars as B
from tickloom.operators import documents as D
from tickloom.operators import kernels as K
from tickloom.operators import pairs, recursive
from tickloom.operators import retrieval as R

from .bar_queries import asof, rounded, rounding, shared
from .oracle import DAILY, TRADES, W, bars_cte

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _split(expressions: str) -> list[str]:
    """A list of SQL expressions at its outer commas."""
    out, depth, quoted = [""], 0, False
    for ch in expressions:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def quotient(a: Column, b: Column) -> Column:
    """a / b with the limits of IEEE arithmetic for a zero ``b``: infinite with the signs of both (also of -0.0), NaN for zero by zero."""
    inf = F.lit(float("inf"))
    return F.when(b == 0, a * F.when(b.cast("string") == "-0.0", -inf).otherwise(inf)).otherwise(F.try_divide(a, b))


def trades(s, d):
    """Trades from lineitem: symbol, side, shares, price, commission, ts and a total order (ok, ln)."""
    x = s.read.parquet(f"{d}/lineitem.parquet")
    return x.select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("shares"), quotient(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        (F.col("l_tax") * F.col("l_extendedprice")).alias("commission"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))


# recursive indicators: recursive SQL over numbered bars
def recursive_sql(first: str, step: str, out: str, extra: str = "", where: str = "n.rn = r.rn + 1") -> str:
    return f"""WITH RECURSIVE {bars_cte()}, n AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc{extra} FROM bars WINDOW {W}),
  r AS ({first} UNION ALL {step} FROM r JOIN n ON n.symbol = r.symbol AND {where}) {out}"""


for name, build in affine.INDICATORS.items():
    query(name)(lambda s, d, build=build: rounded(build(B.bars_of(s, d))))
for name in recursive.SERIES:
    query(name)(lambda s, d, name=name: recursive.indicator(B.bars_of(s, d), name, 6))
SQL["ema"] = recursive_sql("SELECT symbol, ts, rn, close AS a, close AS b FROM n WHERE rn = 1", "SELECT n.symbol, n.ts, n.rn, r.a + 2.0 / 11 * (n.close - r.a), r.b + 2.0 / 21 * (n.close - r.b)", "SELECT symbol, ts, round(a, 6) AS ema10, round(b, 6) AS ema20 FROM r")
_TR14 = ", greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr"
SQL["atr_wilder"] = f"""WITH RECURSIVE {bars_cte()}, t AS (SELECT *, row_number() OVER w AS rn{_TR14} FROM bars WINDOW {W}),
  r AS (SELECT symbol, 14::BIGINT AS rn, avg(tr) AS a FROM t WHERE rn <= 14 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT t.symbol, t.rn, (r.a * 13 + t.tr) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.rn = r.rn + 1)
  SELECT t.symbol, t.ts, round(a, 6) AS atr FROM t LEFT JOIN r USING (symbol, rn)"""
SQL["rsi"] = f"""WITH RECURSIVE {bars_cte()}, t AS (SELECT *, row_number() OVER w AS rn, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l FROM bars WINDOW {W}),
  r AS (SELECT symbol, 15::BIGINT AS rn, avg(g) AS g, avg(l) AS l FROM t WHERE rn BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT t.symbol, t.rn, (r.g * 13 + t.g) / 14, (r.l * 13 + t.l) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.rn = r.rn + 1)
  SELECT t.symbol, t.ts, round(CASE WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 6) AS rsi FROM t LEFT JOIN r USING (symbol, rn)"""
SQL["macd"] = recursive_sql("SELECT symbol, ts, rn, close AS a, close AS b, 0.0::DOUBLE AS s FROM n WHERE rn = 1", """SELECT n.symbol, n.ts, n.rn, r.a + 2.0 / 13 * (n.close - r.a), r.b + 2.0 / 27 * (n.close - r.b),
    r.s + 0.2 * (r.a + 2.0 / 13 * (n.close - r.a) - r.b - 2.0 / 27 * (n.close - r.b) - r.s)""", "SELECT symbol, ts, round(a - b, 6) AS macd, round(s, 6) AS macd_signal, round(a - b - s, 6) AS macd_hist FROM r")
SQL["kama"] = f"""WITH RECURSIVE {bars_cte()}, t AS (SELECT *, row_number() OVER w AS rn, abs(close - lag(close) OVER w) AS m, abs(close - lag(close, 10) OVER w) AS d FROM bars WINDOW {W}),
  e AS (SELECT *, power(coalesce(d / nullif(sum(m) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc FROM t),
  r AS (SELECT symbol, rn, close AS k FROM e WHERE rn = 10 UNION ALL SELECT e.symbol, e.rn, r.k + e.sc * (e.close - r.k) FROM r JOIN e ON e.symbol = r.symbol AND e.rn = r.rn + 1)
  SELECT e.symbol, e.ts, round(k, 6) AS kama FROM e LEFT JOIN r USING (symbol, rn)"""

SQL["vpin"] = f"""WITH RECURSIVE {bars_cte()}, n AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, sum(volume) OVER (PARTITION BY symbol) / 50 AS size FROM bars WINDOW {W}),
  r AS (SELECT symbol, ts, rn, 0e0 AS u, 0e0 AS d, NULL::DOUBLE AS v FROM n WHERE rn = 1
  UNION ALL SELECT symbol, ts, rn, CASE WHEN done THEN 0 ELSE u1 END, CASE WHEN done THEN 0 ELSE d1 END, CASE WHEN done THEN abs(u1 - d1) / (u1 + d1) END FROM (SELECT *, u1 + d1 >= size AS done FROM (
    SELECT n.symbol, n.ts, n.rn, n.size, r.u + CASE WHEN n.close > n.pc THEN n.volume WHEN n.close < n.pc THEN 0 ELSE n.volume / 2 END AS u1, r.d + CASE WHEN n.close < n.pc THEN n.volume WHEN n.close > n.pc THEN 0 ELSE n.volume / 2 END AS d1
    FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1)))
  SELECT symbol, ts, round(v, 6) AS vpin FROM r"""
# averages of directional moves, their index, and its average, seeded by means
SQL["adx"] = f"""WITH RECURSIVE {bars_cte()}, l AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS bars, coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS dn{_TR14} FROM bars WINDOW {W}),
  x AS MATERIALIZED (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pl, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mi FROM l WHERE bars >= 28),
  s AS (SELECT symbol, 14::BIGINT AS rn, avg(pl) AS p, avg(mi) AS m, avg(tr) AS t FROM x WHERE rn BETWEEN 2 AND 14 GROUP BY 1 UNION ALL SELECT x.symbol, x.rn, s.p + (x.pl - s.p) / 14, s.m + (x.mi - s.m) / 14, s.t + (x.tr - s.t) / 14 FROM s JOIN x ON x.symbol = s.symbol AND x.rn = s.rn + 1),
  d AS MATERIALIZED (SELECT symbol, rn, CASE WHEN p / t + m / t > 0 THEN 100 * abs(100 * p / t - 100 * m / t) / (100 * p / t + 100 * m / t) ELSE 0 END AS dx FROM s),
  a AS (SELECT symbol, 28::BIGINT AS rn, avg(dx) AS a FROM d WHERE rn BETWEEN 15 AND 28 GROUP BY 1 UNION ALL SELECT d.symbol, d.rn, a.a + (d.dx - a.a) / 14 FROM a JOIN d ON d.symbol = a.symbol AND d.rn = a.rn + 1)
  SELECT b.symbol, b.ts, round(a, 6) AS adx FROM l b LEFT JOIN a ON a.symbol = b.symbol AND a.rn = b.rn"""

# joins
query("align_inner", f"WITH {bars_cte()}, a AS (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)) SELECT symbol, ts, round(close, 6) AS close FROM bars SEMI JOIN a USING (ts)")(
    lambda s, d: rounded((b := B.bars_of(s, d)).join(b.groupBy("ts").agg(F.count("*").alias("n")).join(F.broadcast(b.agg(F.count_distinct("symbol").alias("n"))), "n", "left_semi"), "ts", "left_semi").select("symbol", "ts", "close")))
_FUND = "f AS (SELECT symbol, ts, (close - open) / open / 100 AS rate FROM daily WHERE dayofweek(ts) = 1)"
query("asof_funding", f"WITH {DAILY}, {_FUND} SELECT d.symbol, d.ts, round(rate, 8) AS rate FROM daily d ASOF LEFT JOIN f ON d.symbol = f.symbol AND d.ts >= f.ts")(
    lambda s, d: rounded(asof((b := B.daily_bars(s, d)).select("symbol", "ts"), b.filter("dayofweek(ts) = 2").selectExpr("symbol", "ts", "(close - open) / open / 100 AS rate"), "rate"), 8))
query("asof_latest_price", f"WITH {DAILY} SELECT symbol, round(arg_max(close, ts), 6) AS close, max(ts) AS ts FROM daily WHERE ts <= TIMESTAMP '1998-06-15' AND ts >= TIMESTAMP '1998-06-15' - INTERVAL 30 DAY GROUP BY 1")(
    lambda s, d: rounded(B.daily_bars(s, d).filter("ts BETWEEN timestamp_ntz'1998-06-15' - INTERVAL 30 DAY AND timestamp_ntz'1998-06-15'").groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"))))
#: Bounds of notional and the maintenance rate between them.
_TIERS = [(0, 5e4, 0.004), (5e4, 2.5e5, 0.005), (2.5e5, 1e6, 0.01), (1e6, 1e7, 0.025), (1e7, 2e7, 0.05), (2e7, 5e7, 0.1), (5e7, 1e8, 0.125), (1e8, 2e8, 0.15), (2e8, 1e18, 0.25)]
_TV = ", ".join(f"({a!r}, {b!r}, {c!r})" for a, b, c in _TIERS)
query("tier_range", f"SELECT o_orderkey, rate, round(o_totalprice * 3 * rate, 6) AS margin FROM orders JOIN (VALUES {_TV}) t(lo, hi, rate) ON o_totalprice * 3 > lo AND o_totalprice * 3 <= hi")(
    lambda s, d: rounded(s.read.parquet(f"{d}/orders.parquet").withColumn("notional", F.col("o_totalprice") * 3).join(F.broadcast(s.createDataFrame([(float(a), float(b), c) for a, b, c in _TIERS], "lo double, hi double, rate double")), F.expr("notional > lo AND notional <= hi")).selectExpr("o_orderkey", "rate", "notional * rate AS margin")))
_POS = "SELECT l_partkey AS part, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS qty FROM lineitem WHERE l_suppkey % 2 = {} GROUP BY 1"
query("recon_full_outer", f"WITH a AS ({_POS.format(0)}), b AS ({_POS.format(1)}) SELECT coalesce(a.part, b.part) AS part, coalesce(a.qty, 0) AS ours, coalesce(b.qty, 0) AS theirs, abs(coalesce(a.qty, 0) - coalesce(b.qty, 0)) > 1e-8 AS differs FROM a FULL JOIN b ON a.part = b.part")(
    lambda s, d: (x := s.read.parquet(f"{d}/lineitem.parquet").withColumn("q", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity")))) and x.filter("l_suppkey % 2 = 0").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("q").alias("ours")).join(x.filter("l_suppkey % 2 = 1").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("q").alias("theirs")), "part", "full_outer").na.fill(0.0, ["ours", "theirs"]).withColumn("differs", F.abs(F.col("ours") - F.col("theirs")) > 1e-8))
query("fills_tolerance", f"""WITH {TRADES}, l AS (SELECT symbol, side, shares, price * 1.0005 AS lp, ts + INTERVAL 30 SECOND AS lts, ok, ln FROM trades WHERE ok % 7 <> 0),
  m AS (SELECT t.ok, t.ln, l.lp, l.lts, t.price, t.ts, row_number() OVER (PARTITION BY t.ok, t.ln ORDER BY abs(date_diff('second', t.ts, l.lts)), l.ln) AS rn FROM trades t LEFT JOIN l ON t.ok = l.ok AND t.symbol = l.symbol AND t.side = l.side AND t.shares::INT = l.shares::INT AND abs(date_diff('second', t.ts, l.lts)) <= 120)
  SELECT ok, ln, lp IS NOT NULL AS matched, round((lp / price - 1) * 1e4, 4) AS bps, date_diff('second', ts, lts) AS delay FROM m WHERE rn = 1""")(lambda s, d: _fills(s, d))


def _second(ts: str) -> str:
    """Whole seconds since 1970 of a time, floored: their differences count the seconds that begin between two times, as ``date_diff`` does."""
    micros = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {ts})"
    return f"({micros} - pmod({micros}, 1000000)) div 1000000"


def _fills(s, d):
    """Each trade's nearest live fill of its order; what SQL leaves open between rows of one (ok, ln) goes to the nearest price, so that reruns agree."""
    t = trades(s, d).selectExpr("*", "CAST(rint(shares) AS INT) AS q", f"{_second('ts')} AS sec")
    live = t.filter("ok % 7 <> 0").selectExpr("symbol AS s2", "side AS d2", "q AS q2", "price * 1.0005 AS lp", f"{_second('ts + INTERVAL 30 SECOND')} AS lsec", "ok AS ok2", "ln AS ln2")
    m = t.join(live, F.expr("ok = ok2 AND symbol = s2 AND side = d2 AND q = q2 AND abs(lsec - sec) <= 120"), "left")
    m = m.select("ok", "ln", "ln2", F.col("lp").isNotNull().alias("matched"), rounding((quotient(F.col("lp"), F.col("price")) - 1) * 1e4, 4).alias("bps"), F.expr("lsec - sec AS delay"))
    first = F.row_number().over(Window.partitionBy("ok", "ln").orderBy(F.abs("delay").asc_nulls_last(), F.col("ln2").asc_nulls_last(), F.abs("bps"), "delay", "bps", "matched"))
    return m.withColumn("rn", first).filter("rn = 1").select("ok", "ln", "matched", "bps", "delay")


query("grid_anti", "SELECT s, l FROM (SELECT unnest(range(2, 30)) AS s) a, (SELECT unnest(range(5, 60, 5)) AS l) b WHERE s < l AND (s, l) NOT IN (SELECT a.s, b.l FROM (SELECT unnest(range(5, 25, 5)) AS s) a, (SELECT unnest(range(10, 60, 10)) AS l) b)")(
    lambda s, d: s.range(2, 30).selectExpr("id AS s").crossJoin(s.range(5, 60, 5).selectExpr("id AS l")).filter("s < l").join(s.range(5, 25, 5).selectExpr("id AS s").crossJoin(s.range(10, 60, 10).selectExpr("id AS l")), ["s", "l"], "left_anti"))


def _returns(bars):
    return bars.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1)


query("pair_corr", f"""WITH {bars_cte()}, r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r FROM bars WINDOW {W}) SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r, b.r), 6) AS corr, count(*) AS n FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""")(
    lambda s, d: rounded(pairs.correlations(_returns(B.bars_of(s, d)), "r").select("a", "b", "corr", "n")))

# metrics over the equity curve that compounds daily returns of each symbol
_EQ = f"{DAILY}, r AS (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS rn, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM daily WINDOW {W})"


def _curve(s, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    return B.daily_bars(s, d).select("symbol", "ts", "close").withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("rn", F.row_number().over(w)).withColumn("peak", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))


query("metrics_bundle", f"""WITH {_EQ} SELECT symbol, count(*) AS n, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS total_return, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 6) AS sharpe,
  round(avg(r) * 252 / (stddev_samp(r) FILTER (r < 0) * sqrt(252)), 6) AS sortino, round(min(close / peak - 1), 6) AS max_drawdown, round(sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0), 6) AS omega, round(avg((r > 0)::INT), 6) AS win_rate,
  round(quantile_cont(r, 0.05), 6) AS var95, round(quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)), 6) AS tail_ratio, round(kurtosis_pop(r), 4) AS kurtosis FROM r GROUP BY 1""")(
    lambda s, d: _curve(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max_by("close", "ts") / F.min_by("close", "ts") - 1, 6).alias("total_return"), F.round(F.stddev_samp("r") * F.sqrt(F.lit(252)), 6).alias("volatility"),
        F.round(F.avg("r") * 252 / (F.stddev_samp("r") * F.sqrt(F.lit(252))), 6).alias("sharpe"), F.expr("round(avg(r) * 252 / (stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252)), 6) AS sortino"), F.expr("round(min(close / peak - 1), 6) AS max_drawdown"),
        F.expr("round(sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0), 6) AS omega"), F.expr("round(avg(CAST(r > 0 AS INT)), 6) AS win_rate"), F.expr("round(percentile(r, 0.05), 6) AS var95"), F.expr("round(percentile(r, 0.95) / abs(percentile(r, 0.05)), 6) AS tail_ratio"), F.round(F.kurtosis("r"), 4).alias("kurtosis")))
query("var_cvar", f"WITH {_EQ}, v AS (SELECT symbol, quantile_cont(r, 0.05) AS v FROM r GROUP BY 1) SELECT symbol, round(any_value(v), 6) AS var95, round(avg(r), 6) AS cvar95 FROM r JOIN v USING (symbol) WHERE r <= v GROUP BY 1")(
    lambda s, d: rounded((c := _curve(s, d)).join(c.groupBy("symbol").agg(F.expr("percentile(r, 0.05) AS v")), "symbol").filter("r <= v").groupBy("symbol").agg(F.first("v").alias("var95"), F.avg("r").alias("cvar95"))))
query("drawdown_series", f"WITH {_EQ} SELECT symbol, ts, round((close / peak - 1) * 100, 6) AS drawdown_pct FROM r")(lambda s, d: rounded(_curve(s, d).selectExpr("symbol", "ts", "(close / peak - 1) * 100 AS drawdown_pct")))
query("underwater", f"WITH {_EQ}, g AS (SELECT *, sum((close >= peak)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM r), c AS (SELECT symbol, g, count(*) FILTER (close < peak) AS n FROM g GROUP BY 1, 2) SELECT symbol, max(n) AS longest FROM c GROUP BY 1")(
    lambda s, d: _curve(s, d).withColumn("g", F.sum(F.expr("CAST(close >= peak AS INT)")).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).groupBy("symbol", "g").agg(F.count_if(F.expr("close < peak")).alias("n")).groupBy("symbol").agg(F.max("n").alias("longest")))
query("rolling_sharpe", f"WITH {_EQ} SELECT symbol, ts, round(CASE WHEN rn >= 61 THEN avg(r) OVER f / stddev_samp(r) OVER f * sqrt(252) END, 6) AS sharpe60 FROM r WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)")(
    lambda s, d: rounded(_curve(s, d).select("symbol", "ts", F.when(F.col("rn") >= 61, F.avg("r").over(f := Window.partitionBy("symbol").orderBy("ts").rowsBetween(-59, 0)) / F.stddev_samp("r").over(f) * F.sqrt(F.lit(252))).alias("sharpe60"))))

# trades
_PNL = f"{TRADES}, p AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares - commission AS pnl FROM trades)"


def _pnl(s, d):
    return trades(s, d).withColumn("pnl", F.expr("CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares - commission"))


query("strategy_stats", f"""WITH {_PNL} SELECT symbol, side, count(*) AS n, count_if(pnl > 0) AS wins, count_if(pnl < 0) AS losses, round(sum(pnl), 2) AS total, round(avg(pnl), 4) AS expectancy, round(least(99.99, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0)), 6) AS profit_factor,
  round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*)), 6) AS sharpe_proxy FROM p GROUP BY 1, 2""")(
    lambda s, d: _pnl(s, d).groupBy("symbol", "side").agg(F.count("*").alias("n"), F.count_if(F.expr("pnl > 0")).alias("wins"), F.count_if(F.expr("pnl < 0")).alias("losses"), F.round(F.sum("pnl"), 2).alias("total"), F.round(F.avg("pnl"), 4).alias("expectancy"),
        F.expr("round(least(99.99, sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0)), 6) AS profit_factor"), F.expr("round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*)), 6) AS sharpe_proxy")))
query("daily_pnl", f"WITH {_PNL} SELECT ts::DATE AS day, round(sum(pnl), 2) AS pnl, count(*) AS n FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 30")(lambda s, d: _pnl(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("pnl"), 2).alias("pnl"), F.count("*").alias("n")).orderBy(F.desc("day")).limit(30))
query("cumulative_pnl", f"WITH {_PNL}, x AS (SELECT ts::DATE AS day, sum(pnl) AS pnl FROM p GROUP BY 1) SELECT day, round(sum(pnl) OVER (ORDER BY day), 4) AS total FROM x")(lambda s, d: _pnl(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl")).select("day", F.round(F.sum("pnl").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total")))
query("streaks", f"""WITH {_PNL}, q AS (SELECT symbol, side, ok, ln, pnl > 0 AS win, row_number() OVER (PARTITION BY symbol, side ORDER BY ts, ok, ln) - row_number() OVER (PARTITION BY symbol, side, pnl > 0 ORDER BY ts, ok, ln) AS g FROM p),
  c AS (SELECT symbol, side, win, g, count(*) AS n FROM q GROUP BY ALL) SELECT symbol, side, max(n) FILTER (win) AS longest_win, max(n) FILTER (NOT win) AS longest_loss FROM c GROUP BY 1, 2""")(
    lambda s, d: _streaks(s, d))


def _by_month(df, keys, name="k"):
    return B.numbered(df, keys, ["ts", "ok", "ln", "price", "shares"], F.trunc(F.to_date("ts"), "month"), name)


def _streaks(s, d):
    """Runs of equal outcomes: what the number among all less that among its like has in common."""
    rows = _by_month(_by_month(_pnl(s, d).withColumn("win", F.expr("pnl > 0")), ["symbol", "side"], "a"), ["symbol", "side", "win"], "b")
    runs = rows.groupBy("symbol", "side", "win", (F.col("a") - F.col("b")).alias("g")).agg(F.count("*").alias("n"))
    return runs.groupBy("symbol", "side").agg(F.expr("max(n) FILTER (WHERE win) AS longest_win"), F.expr("max(n) FILTER (WHERE NOT win) AS longest_loss"))


query("round_trips", f"""WITH {TRADES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts, ok, ln, price, shares) AS k FROM trades) SELECT b.symbol, count(*) AS trips, count_if(s.price > b.price) AS wins, round(avg(s.price / b.price - 1), 6) AS mean_return FROM n b JOIN n s ON b.symbol = s.symbol AND b.k = s.k AND b.side = 'buy' AND s.side = 'sell' GROUP BY 1""")(
    lambda s, d: _round_trips(s, d))


def _round_trips(s, d):
    """The k-th buy of a symbol with its k-th sell."""
    n = _by_month(trades(s, d), ["symbol", "side"])
    buys = n.filter("side = 'buy'").selectExpr("symbol", "k", "price AS bp")
    sells = n.filter("side = 'sell'").selectExpr("symbol", "k", "price AS sp")
    both = buys.join(sells, ["symbol", "k"])
    return rounded(both.groupBy("symbol").agg(F.count("*").alias("trips"), F.count_if(F.expr("sp > bp")).alias("wins"), F.avg(F.expr("sp / bp - 1")).alias("mean_return")))


query("tca", f"WITH {TRADES} SELECT symbol, round(sum(shares * price), 2) AS notional, round(sum(shares * price * 0.0005), 2) AS slippage, round(sum(commission), 2) AS commission, round((sum(shares * price * 0.0005) + sum(commission)) / sum(shares * price) * 1e4, 4) AS cost_bps FROM trades GROUP BY 1")(
    lambda s, d: trades(s, d).groupBy("symbol").agg(*[F.expr(x) for x in ("round(sum(shares * price), 2) AS notional", "round(sum(shares * price * 0.0005), 2) AS slippage", "round(sum(commission), 2) AS commission", "round((sum(shares * price * 0.0005) + sum(commission)) / sum(shares * price) * 1e4, 4) AS cost_bps")]))
query("latest_per_key", f"WITH {TRADES} SELECT symbol, side, ts, ok, ln, round(price, 6) AS price FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY ts DESC, ok DESC, ln DESC) = 1")(
    lambda s, d: rounded(B.keep_one(trades(s, d), ["symbol", "side"], [F.desc("ts"), F.desc("ok"), F.desc("ln")]).select("symbol", "side", "ts", "ok", "ln", "price")))
query("last_n_trades", f"WITH {TRADES}, x AS (SELECT * FROM trades WHERE symbol = 'R' ORDER BY ts DESC, ok DESC, ln DESC LIMIT 50) SELECT ts, ok, ln, side, round(price, 6) AS price FROM x")(lambda s, d: rounded(trades(s, d).filter("symbol = 'R'").orderBy(F.desc("ts"), F.desc("ok"), F.desc("ln")).limit(50).select("ts", "ok", "ln", "side", "price")))
query("top_n_per_group", f"WITH {TRADES} SELECT symbol, side, ok, ln, round(shares * price, 4) AS notional FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY shares * price DESC, ok, ln) <= 5")(
    lambda s, d: trades(s, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.expr("shares * price").desc(), "ok", "ln"))).filter("n <= 5").select("symbol", "side", "ok", "ln", F.round(F.expr("shares * price"), 4).alias("notional")))
query("account_replay", f"WITH {TRADES} SELECT symbol, round(sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END), 4) AS position, round(sum(CASE WHEN side = 'buy' THEN -shares * price ELSE shares * price END - commission), 2) AS cash FROM trades GROUP BY 1")(
    lambda s, d: trades(s, d).groupBy("symbol").agg(F.expr("round(sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END), 4) AS position"), F.expr("round(sum(CASE WHEN side = 'buy' THEN -shares * price ELSE shares * price END - commission), 2) AS cash")))
_GATE = "CASE WHEN shares > 45 THEN 'shares' WHEN shares * price > 90000 THEN 'notional' WHEN side = 'sell' AND shares > 40 THEN 'position' ELSE 'ok' END"
query("risk_gate", f"WITH {TRADES} SELECT {_GATE} AS verdict, side, count(*) AS n FROM trades GROUP BY 1, 2")(lambda s, d: trades(s, d).groupBy(F.expr(_GATE).alias("verdict"), "side").agg(F.count("*").alias("n")))
query("fill_costs", f"WITH {TRADES} SELECT ok, ln, round(shares * price * CASE WHEN side = 'buy' THEN 1.0005 ELSE 0.9995 END, 7) AS fill_value, round(0.1 * power(shares / 1000, 0.5), 6) AS impact, round(greatest(1, 0.005 * shares), 6) AS equity_commission FROM trades")(
    lambda s, d: trades(s, d).select("ok", "ln", F.expr("round(shares * price * CASE WHEN side = 'buy' THEN 1.0005 ELSE 0.9995 END, 7) AS fill_value"), F.expr("round(0.1 * power(shares / 1000, 0.5), 6) AS impact"), F.expr("round(CAST(greatest(1, 0.005 * shares) AS DOUBLE), 6) AS equity_commission")))
query("twap_slices", "SELECT o_orderkey, i::INT AS slice, o_orderdate + to_minutes((i * 5)::INT) AS at, round(o_totalprice / 4, 6) AS notional FROM orders, (SELECT unnest(range(4)) AS i)")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("o_orderkey", "slice", (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, slice * 5, 0)")).alias("at"), F.round(F.col("o_totalprice") / 4, 6).alias("notional")))
query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS top, quantile_cont(value, 0.99) <= 400 AS healthy FROM events GROUP BY 1")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *[F.expr(f"round(percentile(value, {q}), 6) AS {k}") for q, k in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))], F.round(F.max("value"), 6).alias("top"), F.expr("percentile(value, 0.99) <= 400 AS healthy")))
query("upsert", "WITH old AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS t FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new' END AS t FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(new.k, old.k) AS k, round(coalesce(new.v, old.v), 4) AS v, coalesce(new.t, old.t) AS t FROM old FULL JOIN new ON old.k = new.k")(
    lambda s, d: (c := s.read.parquet(f"{d}/customer.parquet")) and c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_acctbal AS v0", "c_mktsegment AS t0").join(c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_acctbal + 1 AS v1", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new' END AS t1"), "k", "full_outer").selectExpr("k", "round(coalesce(v1, v0), 4) AS v", "coalesce(t1, t0) AS t"))
query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(props) AS n FROM events GROUP BY 1")(lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.sum(F.from_json("props", "k BIGINT")["k"]).alias("total"), F.count("props").alias("n")))
query("sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 86400 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM g GROUP BY user_id, g")(
    lambda s, d: (w := Window.partitionBy("user_id").orderBy("ts", "event_id")) and s.read.parquet(f"{d}/events.parquet").withColumn("new", F.when(F.lag("ts").over(w).isNull() | (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp")) > 86400), 1).otherwise(0)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "g").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).drop("g"))

# regime and health
query("anomaly", f"""WITH {_EQ}, x AS (SELECT *, lag(r) OVER w AS pr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM r WINDOW {W}) SELECT symbol, round(corr(r, pr), 6) AS autocorr, round(corr(r, pr) FILTER (back <= 60), 6) AS recent_autocorr, round(stddev_pop(r) FILTER (back <= 60) / stddev_pop(r), 6) AS vol_ratio FROM x GROUP BY 1""")(
    lambda s, d: _curve(s, d).withColumn("pr", F.lag("r").over(Window.partitionBy("symbol").orderBy("ts"))).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).groupBy("symbol").agg(F.round(F.corr("r", "pr"), 6).alias("autocorr"), F.expr("round(corr(r, pr) FILTER (WHERE back <= 60), 6) AS recent_autocorr"), F.expr("round(stddev_pop(r) FILTER (WHERE back <= 60) / stddev_pop(r), 6) AS vol_ratio")))
query("health", f"""WITH {_EQ}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM r), h AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, arg_max(close / peak - 1, ts) AS dd, avg((r > 0)::INT) AS win FROM x WHERE back <= 30 GROUP BY 1) SELECT symbol, round(sharpe, 6) AS sharpe, round(dd, 6) AS drawdown, round(win, 6) AS win_rate, CASE WHEN sharpe < 0 OR dd < -0.5 THEN 'ALERT' WHEN win < 0.45 THEN 'WATCH' ELSE 'HEALTHY' END AS status FROM h""")(
    lambda s, d: rounded(_curve(s, d).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter("back <= 30").groupBy("symbol").agg(F.expr("avg(r) / stddev_samp(r) * sqrt(252) AS sharpe"), F.expr("max_by(close / peak - 1, ts) AS drawdown"), F.expr("avg(CAST(r > 0 AS INT)) AS win_rate")).withColumn("status", F.expr("CASE WHEN sharpe < 0 OR drawdown < -0.5 THEN 'ALERT' WHEN win_rate < 0.45 THEN 'WATCH' ELSE 'HEALTHY' END"))))

# retrieval
_SPLIT = r"regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}_]+')"
_POST = rf"t AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1), i AS (SELECT term, 1 + ln(((SELECT count(*) FROM l) + 1) / (count(*) + 1)) AS idf FROM p GROUP BY 1)"


def words():
    """The terms of a text, in order."""
    return R.terms("text")


def postings(s, d):
    """(doc_id, term, tf): the inverted index of the documents."""
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(words()).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


QUERY_TERMS = ["the", "thereou", "avec", "nicht", "para"]


def _is(term):
    return lambda x: x == term


def bm25(s, d, terms=QUERY_TERMS, k1=1.5, b=0.75):
    """(doc_id, score) by BM25 with idf = 1 + ln((N + 1) / (df + 1)); one small row a document, no word leaves it."""
    text = R.spaced(F.col("text"))
    letters = R.WORD[:-1]
    asked = F.regexp_extract_all(text, F.lit(f"(?<!{letters})({'|'.join(terms)})(?!{letters})"), F.lit(1))
    # the numbers of each document are dealt once, for the totals and the scores alike, so texts are read once
    few = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_count(text, F.lit(R.WORD)).alias("len"), asked.alias("hits")).repartition("doc_id").filter("len > 0")
    rows = few.select("doc_id", "len", *[F.size(F.filter("hits", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    facts = rows.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])).scalar()
    rows = rows.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).withColumn("f", facts)
    parts = [F.expr(f"CASE WHEN tf{i} > 0 THEN (1 + ln((f.n + 1) / (f.df{i} + 1))) * tf{i} * ({k1} + 1) / (tf{i} + {k1} * (1 - {b} + {b} * len / f.avgdl)) ELSE 0D END") for i in range(len(terms))]
    return rows.select("doc_id", sum(parts).alias("score"))


def idf(s, d):
    """(term, idf): a word counts once a document, and only words are shuffled."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(words().alias("words")).filter(F.size("words") > 0)
    n = docs.agg(F.count("*")).scalar()
    return docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", (1 + F.log((n + 1) / (F.col("df") + 1))).alias("idf"))


_TERMS = ", ".join(f"'{x}'" for x in QUERY_TERMS)
_BM = f"{_POST}, bm AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM l)))) AS score FROM p JOIN i USING (term) JOIN l USING (doc_id) WHERE term IN ({_TERMS}) GROUP BY 1)"
query("inverted_index", f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p GROUP BY 1")(lambda s, d: postings(s, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
query("idf", f"WITH {_POST} SELECT term, round(idf, 6) AS idf FROM i")(lambda s, d: rounded(idf(s, d)))
query("bm25", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM bm")(lambda s, d: rounded(bm25(s, d)))
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_VEC = f"v AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"
query("vector_topk", f"WITH {_VEC} SELECT query_id, vec_id, round(sim, 5) AS sim FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) <= 10")(
    lambda s, d: D.nearest(s.read.parquet(f"{d}/embeddings.parquet")).withColumn("sim", F.round("sim", 5)))
_HYBRID = f"""{_POST}, {_VEC}, q AS (SELECT DISTINCT doc_id AS query_id, unnest(list_slice({_SPLIT}, 1, 3)) AS term FROM documents WHERE doc_id % 50 = 0),
  bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM l)))) AS score FROM q JOIN p USING (term) JOIN i USING (term) JOIN l USING (doc_id) GROUP BY 1, 2),
  k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS kr FROM bm QUALIFY kr <= 20),
  x AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS xr FROM v QUALIFY xr <= 20),
  h AS (SELECT coalesce(k.query_id, x.query_id) AS query_id, coalesce(k.doc_id, x.doc_id) AS doc_id, coalesce(0.6 / (60 + x.xr), 0) + coalesce(0.4 / (60 + k.kr), 0) AS score FROM k FULL JOIN x ON k.query_id = x.query_id AND k.doc_id = x.doc_id)"""
query("rrf_hybrid", f"WITH {_HYBRID} SELECT query_id, doc_id, round(score, 9) AS score FROM h")(lambda s, d: hybrid(s, d).withColumn("score", F.round("score", 9)))


def keyword_ranks(s, d, every: int = 50, terms: int = 3, most: int = 20):
    """(query_id, doc_id, kr): the best documents by BM25 for the first words of every ``every``-th document."""
    docs, at = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), shared(s)
    asked = docs.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), F.explode(F.slice(words(), 1, terms)).alias("term"))
    R.add(docs, at)
    return R.search(asked, at, most).select("query_id", "doc_id", F.col("rank").alias("kr"))


def hybrid(s, d, most: int = 20):
    """(query_id, doc_id, score): ranks by vector and by keyword fused by reciprocal rank."""
    near = D.nearest(s.read.parquet(f"{d}/embeddings.parquet"), k=most)
    ranked = near.select("query_id", F.col("vec_id").alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")).alias("xr"))
    both = keyword_ranks(s, d, most=most).join(ranked, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", F.expr("coalesce(0.6D / (60 + xr), 0D) + coalesce(0.4D / (60 + kr), 0D) AS score"))


query("fixed_chunks", "SELECT doc_id, i AS idx, substr(text, i * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range((greatest(length(text), 1) + 399) // 400)) AS i FROM documents WHERE text IS NOT NULL)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text", F.explode(F.expr("sequence(0L, CAST((greatest(length(text), 1) + 399) DIV 400 - 1 AS BIGINT))")).alias("idx")).selectExpr("doc_id", "idx", "substring(text, CAST(idx * 400 + 1 AS INT), 500) AS chunk"))
query("dedupe_docs", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")(lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
query("asof_docs", f"WITH {bars_cte('1 day')}, x AS (SELECT doc_id, source, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at FROM documents) SELECT b.symbol, b.ts, count(*) AS known, max(x.doc_id) AS latest FROM bars b JOIN x ON x.created_at < b.ts GROUP BY 1, 2")(
    lambda s, d: _known(s, d))


def _known(s, d):
    """Documents known before each bar: counts by day, summed up over all days there are, and joined by day."""
    x = s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, CAST(doc_id AS INT), 0, 0) AS created_at")
    # known to all bars after it, the first of which begins a day: the day after, unless it is a midnight before
    day = F.to_date(F.col("created_at")) + F.expr("INTERVAL 1 DAY")
    sums = x.groupBy(day.cast("date").alias("day")).agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))
    span = sums.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as the calendar has days
    running = span.join(sums, "day", "left").select("day", F.sum("n").over(w).alias("known"), F.max("latest").over(w).alias("latest"))
    last = sums.agg(F.max("day")).scalar()
    rows = B.bars_of(s, d, "1 day").select("symbol", "ts", F.least(F.to_date("ts"), last).alias("day"))
    return rows.join(running, "day").select("symbol", "ts", "known", "latest")


# strategies
def default_grid(s):
    sets = [(k, i, [float(x) for x in v]) for k, grid in K.GRIDS.items() for i, v in enumerate(grid)]
    return s.createDataFrame(sets, "strategy string, combo_id int, params array<double>")


query("strategy_scan")(lambda s, d: rounded(K.scan(B.bars_of(s, d), default_grid(s))))
query("grid_best")(lambda s, d: rounded(K.best(K.scan(B.bars_of(s, d), default_grid(s)))))


# margin at five times leverage and a 0.4 % maintenance rate, day trades, splits
_LIQ = "round(shares * price * 0.804::DOUBLE, 7) AS liquidation_long, round(shares * price * 1.196::DOUBLE, 7) AS liquidation_short, round(shares * price / 5, 6) AS initial_margin"
query("margin", f"WITH {TRADES} SELECT ok, ln, {_LIQ} FROM trades")(lambda s, d: trades(s, d).select("ok", "ln", F.expr("round(shares * price * 0.804D, 7) AS liquidation_long"), F.expr("round(shares * price * 1.196D, 7) AS liquidation_short"), F.expr("round(shares * price / 5, 6) AS initial_margin")))
query("day_trade_count", f"WITH {DAILY} SELECT symbol, ts, count(*) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n7 FROM daily")(
    lambda s, d: B.daily_bars(s, d).withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))).select("symbol", "ts", F.count("*").over(Window.partitionBy("symbol").orderBy("day").rangeBetween(-7, 0)).alias("n7")))
query("trading_calendar", "SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE isodow(o_orderdate) <= 5 AND strftime(o_orderdate, '%m-%d') NOT IN ('01-01', '07-04', '12-25') GROUP BY 1")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").filter("weekday(o_orderdate) < 5 AND date_format(o_orderdate, 'MM-dd') NOT IN ('01-01', '07-04', '12-25')").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")))


def cpcv_splits(n: int, groups: int = 6, test: int = 2, embargo: int = 0) -> list[tuple[int, int, str]]:
    """(split, bar, role) of combinatorial purged cross-validation: test, train, or embargoed after a test group."""
    from itertools import combinations

    edges = [n * g // groups for g in range(groups + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(groups), test)):
        inside = [any(edges[g] <= i < edges[g + 1] for g in chosen) for i in range(n)]
        late = [any(edges[g + 1] <= i < edges[g + 1] + embargo for g in chosen) for i in range(n)]
        out += [(k, i, "test" if a else "embargo" if b else "train") for i, (a, b) in enumerate(zip(inside, late, strict=True))]
    return out


query("cpcv_split", """WITH g AS (SELECT a.range AS a, b.range AS b, row_number() OVER (ORDER BY a.range, b.range) - 1 AS split FROM range(6) a, range(6) b WHERE a.range < b.range),
  x AS (SELECT split, i.range AS bar, CASE WHEN i.range // 100 IN (a, b) THEN 'test' WHEN (i.range // 100 - 1 IN (a, b)) AND i.range % 100 < 5 THEN 'embargo' ELSE 'train' END AS role FROM g, range(600) i)
  SELECT split::INT AS split, role, count(*) AS n, sum(bar)::BIGINT AS total FROM x GROUP BY 1, 2""")(
    lambda s, d: s.createDataFrame(cpcv_splits(600, embargo=5), "split int, bar int, role string").groupBy("split", "role").agg(F.count("*").alias("n"), F.sum("bar").alias("total")))
query("walk_forward_split", f"WITH {bars_cte()}, n AS (SELECT symbol, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n, close FROM bars WINDOW {W}) SELECT symbol, CASE WHEN rn <= 0.6 * n THEN 'train' WHEN rn <= 0.6 * n + 5 THEN 'embargo' WHEN rn <= 0.8 * n THEN 'val' ELSE 'test' END AS part, count(*) AS bars, round(avg(close), 6) AS mean_close FROM n GROUP BY 1, 2")(
    lambda s, d: rounded(B.bars_of(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).groupBy("symbol", F.expr("CASE WHEN rn <= 0.6 * n THEN 'train' WHEN rn <= 0.6 * n + 5 THEN 'embargo' WHEN rn <= 0.8 * n THEN 'val' ELSE 'test' END").alias("part")).agg(F.count("*").alias("bars"), F.avg("close").alias("mean_close"))))
query("retention", f"WITH {TRADES} SELECT symbol, ok, ln FROM trades WHERE ts >= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, ok DESC, ln DESC, price DESC, shares DESC) <= 100")(
    lambda s, d: trades(s, d).filter("ts >= timestamp_ntz'1999-01-01'").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in ("ts", "ok", "ln", "price", "shares")]))).filter("n <= 100").select("symbol", "ok", "ln"))
