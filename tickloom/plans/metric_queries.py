"""Metrics, audits, scores and reference tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import kernels as K
from tickloom.operators import metrics as M
from tickloom.operators import research as R

from .analytics_queries import _fills, _pnl, _split, trades
from .bar_queries import rounded
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


def curve(s, d):
    return B.daily_bars(s, d).select("symbol", "ts", F.col("close").alias("equity"))


def _cdf(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2e0))", f"(1 / (1 + {M.ERF_P} * abs({z}) / sqrt(2e0)))"
    poly = "0e0"
    for c in reversed(M.ERF):
        poly = f"({t} * ({c!r}e0 + {poly}))"
    erf = f"(1 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


_TRIALS = sum(len(x) for x in K.GRIDS.values())
_CURVE = f"""{DAILY}, c0 AS (SELECT symbol, ts, close AS equity, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS rn, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM daily WINDOW {W}),
  c1 AS (SELECT *, equity / peak - 1 AS dd, sum((equity >= peak)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM c0),
  tr AS (SELECT symbol, min(rn) AS trough, any_value(peak) AS top FROM c1 QUALIFY dd = min(dd) OVER (PARTITION BY symbol) GROUP BY symbol)"""
_CURVE = _CURVE.replace("tr AS (SELECT symbol, min(rn) AS trough, any_value(peak) AS top FROM c1 QUALIFY dd = min(dd) OVER (PARTITION BY symbol) GROUP BY symbol)", "tr AS (SELECT symbol, min(rn) AS trough, arg_min(peak, rn) AS top FROM (SELECT *, min(dd) OVER (PARTITION BY symbol) AS least FROM c1) WHERE dd = least GROUP BY symbol)")


def _metrics_sql(per_year: int, trials: int) -> str:
    sharpe = f"((mean * {per_year} - 0.03) / volatility)"
    error = f"sqrt((1 + 0.5 * {sharpe} * {sharpe} - skewness * {sharpe} + kurtosis_excess / 4 * {sharpe} * {sharpe}) / greatest(1, n - 1))"
    return f"""WITH {_CURVE}, q AS (SELECT symbol, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95, quantile_cont(r, 0.01) AS q01 FROM c1 GROUP BY 1),
  u AS (SELECT symbol, max(n) AS longest FROM (SELECT symbol, g, count(*) FILTER (equity < peak) AS n FROM c1 GROUP BY 1, 2) GROUP BY 1),
  a AS (SELECT c1.symbol, count(*) AS trading_days, count(r) AS n, arg_min(equity, ts) AS first, arg_max(equity, ts) AS final_value, avg(r) AS mean, stddev_samp(r) * sqrt({per_year}) AS volatility, stddev_samp(r) FILTER (r < 0) AS down,
    min(dd) AS max_drawdown, min(rn) FILTER (rn <= trough AND equity = top) - 1 AS max_drawdown_peak_idx, any_value(trough) - 1 AS max_drawdown_trough_idx, coalesce(min(rn) FILTER (rn > trough AND equity >= top), count(*)) - 1 AS max_drawdown_recovery_idx,
    sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS omega_ratio, avg((r > 0)::INT) AS win_rate, any_value(q05) AS value_at_risk_95, any_value(q01) AS value_at_risk_99, avg(r) FILTER (r <= q05) AS cvar_95, avg(r) FILTER (r <= q01) AS cvar_99,
    any_value(q95) / abs(any_value(q05)) AS tail_ratio, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * power(avg(r), 3)) / power(stddev_pop(r), 3) AS skewness, kurtosis_pop(r) AS kurtosis_excess
    FROM c1 JOIN q USING (symbol) JOIN tr USING (symbol) GROUP BY c1.symbol)
  SELECT a.symbol, trading_days, round(final_value, 4) AS final_value, round(volatility, 4) AS volatility, round(max_drawdown, 4) AS max_drawdown, max_drawdown_peak_idx, max_drawdown_trough_idx, max_drawdown_recovery_idx, longest AS max_drawdown_duration,
    round(omega_ratio, 4) AS omega_ratio, round(win_rate, 4) AS win_rate, round(value_at_risk_95, 4) AS value_at_risk_95, round(value_at_risk_99, 4) AS value_at_risk_99, round(cvar_95, 4) AS cvar_95, round(cvar_99, 4) AS cvar_99,
    round(tail_ratio, 4) AS tail_ratio, round(skewness, 4) AS skewness, round(kurtosis_excess, 4) AS kurtosis_excess, round(final_value / first - 1, 4) AS total_return, round(power(final_value / first, {per_year} / (trading_days - 1)) - 1, 4) AS annual_return,
    round({sharpe}, 4) AS sharpe_ratio, round((mean * {per_year} - 0.03) / (down * sqrt({per_year})), 4) AS sortino_ratio, round(CASE WHEN max_drawdown = 0 THEN 0 ELSE (power(final_value / first, {per_year} / (trading_days - 1)) - 1) / -max_drawdown END, 4) AS calmar_ratio,
    round(CASE WHEN n < 2 OR {error} < 1e-15 THEN 1 ELSE 1 - {_cdf(f"(({sharpe} - {M.expected_best(trials)!r}) / {error})")} END, 4) AS deflated_sharpe_pvalue FROM a JOIN u USING (symbol)"""


query("metrics_full", _metrics_sql(252, _TRIALS))(lambda s, d: rounded(M.bundle(curve(s, d), _TRIALS), 4))
query("metrics_365", _metrics_sql(365, 1))(lambda s, d: rounded(M.bundle(curve(s, d), 1, per_year=365.0), 4))
_SP = f"spread AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, count(r)::DOUBLE AS n FROM c1 GROUP BY 1)"
_ROOT = f"sqrt(2 * ln({float(_TRIALS)}))"
query("deflated_sharpe", f"WITH {_CURVE}, {_SP}, z AS (SELECT *, (sharpe - (0.4228 * {_ROOT} + 0.5772 / {_ROOT})) / sqrt((1 + 0.5 * sharpe * sharpe) / greatest(1, n - 1)) AS z FROM spread) SELECT symbol, round(CASE WHEN n < 3 THEN 0 ELSE {_cdf('z')} END, 6) AS probability FROM z")(
    lambda s, d: M.curve(curve(s, d)).groupBy("symbol").agg((F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252))).alias("sharpe"), F.count("r").cast("double").alias("n")).select("symbol", F.round(M.deflated_probability(F.col("sharpe"), F.lit(float(_TRIALS)), F.col("n")), 6).alias("probability")))

# costs of trading: what a symbol's trades cost, and what is left of its Sharpe ratio
_PNL = f"{TRADES}, p AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares AS pnl, CASE side WHEN 'buy' THEN 5e0 ELSE 3e0 END AS bps FROM trades)"
_TCA = "count(*) AS trades, sum(commission) AS commission, sum(shares * price * bps / 1e4) AS slippage, avg(bps) AS mean_bps"
_NET = "symbol, trades, round(commission, 2) AS commission, round(slippage, 2) AS slippage, round((commission + slippage) / trades, 4) AS cost_per_trade, round(mean_bps, 4) AS mean_bps, round(m / sd * sqrt(252), 6) AS gross_sharpe, round((m - (commission + slippage) / n / 1e9) / sd * sqrt(252), 6) AS net_sharpe, round((commission + slippage) / abs(total) * 100, 4) AS cost_pct_of_pnl"
query("tca_report", f"WITH {_PNL}, c AS (SELECT symbol, {_TCA} FROM p GROUP BY 1), y AS (SELECT symbol, ts::DATE AS day, sum(pnl) AS pnl FROM p GROUP BY 1, 2), r AS (SELECT symbol, avg(pnl / 1e9) AS m, stddev_pop(pnl / 1e9) AS sd, count(*) AS n, sum(pnl) AS total FROM y GROUP BY 1) SELECT {_NET} FROM c JOIN r USING (symbol)")(
    lambda s, d: _tca(s, d))


def _tca(s, d, capital="1e9"):
    p = trades(s, d).selectExpr("*", "CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares AS pnl", "CASE side WHEN 'buy' THEN 5D ELSE 3D END AS bps")
    costs = p.groupBy("symbol").agg(*[F.expr(x) for x in _split(_TCA)])
    days = p.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    returns = days.groupBy("symbol").agg(*[F.expr(x) for x in (f"avg(pnl / {capital}) AS m", f"stddev_pop(pnl / {capital}) AS sd", "count(*) AS n", "sum(pnl) AS total")])
    return costs.join(returns, "symbol").selectExpr(*_split(_NET))


@query("tca_markdown", f"WITH {TRADES} SELECT symbol, '| ' || symbol || ' | ' || count(*) || ' | ' || printf('%.2f', sum(commission)) || ' |' AS line FROM trades GROUP BY 1")
def tca_markdown(s, d):
    """A line of a Markdown table for each symbol."""
    return trades(s, d).groupBy("symbol").agg(F.format_string("| %s | %d | %.2f |", F.first("symbol"), F.count("*"), F.sum("commission")).alias("line"))


_FILL = f"""{TRADES}, l AS (SELECT symbol, side, shares, price * 1.0005 AS lp, ts + INTERVAL 30 SECOND AS lts, ok, ln FROM trades WHERE ok % 7 <> 0),
  m AS (SELECT t.ok, t.ln, l.lp, l.lts, t.price, t.ts, row_number() OVER (PARTITION BY t.ok, t.ln ORDER BY abs(date_diff('second', t.ts, l.lts)), l.ln) AS rn FROM trades t LEFT JOIN l ON t.ok = l.ok AND t.symbol = l.symbol AND t.side = l.side AND t.shares::INT = l.shares::INT AND abs(date_diff('second', t.ts, l.lts)) <= 120),
  x AS (SELECT lp IS NOT NULL AS matched, round((lp / price - 1) * 1e4, 4) AS bps, date_diff('second', ts, lts) AS delay FROM m WHERE rn = 1)"""
query("divergence_summary", f"WITH {_FILL} SELECT count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS missing, round(avg(abs(delay)), 6) AS mean_delay, round(quantile_cont(abs(delay), 0.95), 6) AS p95_delay, round(avg(abs(bps)), 6) AS mean_bps, round(quantile_cont(abs(bps), 0.95), 6) AS p95_bps, count(*) FILTER (abs(bps) <= 10) AS within FROM x")(
    lambda s, d: _fills(s, d).agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("missing"), *[F.expr(x) for x in ("round(avg(abs(delay)), 6) AS mean_delay", "round(percentile(abs(delay), 0.95), 6) AS p95_delay", "round(avg(abs(bps)), 6) AS mean_bps", "round(percentile(abs(bps), 0.95), 6) AS p95_bps", "count_if(abs(bps) <= 10) AS within")]))
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, (SELECT count(*) FROM (SELECT unnest(string_split(column_names, ',')) FROM (SELECT string_agg(column_name, ',') AS column_names FROM (DESCRIBE {t}))))::INT AS columns FROM {t}" for t in _TABLES))
def table_counts(s, d):
    """Rows from the files' footers and columns from their schemas; no data is read."""
    frames = [(t, s.read.parquet(f"{d}/{t}.parquet")) for t in _TABLES]
    out = None
    for t, df in frames:
        one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


query("journal_summary", f"WITH {TRADES}, p AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price - 1200) * shares - commission AS pnl FROM trades) SELECT count(*) AS n, round(coalesce(sum(pnl), 0), 2) AS pnl, round(coalesce(sum(commission), 0), 2) AS commission, round(arg_max(price, (ts, ok, ln)), 4) AS last_price FROM p")(
    lambda s, d: _pnl(s, d).agg(F.count("*").alias("n"), F.expr("round(coalesce(sum(pnl), 0D), 2) AS pnl"), F.expr("round(coalesce(sum(commission), 0D), 2) AS commission"), F.round(F.max_by("price", F.struct("ts", "ok", "ln")), 4).alias("last_price")))
_NEED = f"CAST(ceil({_TRIALS} / 0.05e0) AS BIGINT)"
query("bias_audit", f"WITH {_CURVE}, b AS (SELECT symbol, count(*) AS bars, max(ts) AS last_ts FROM c1 GROUP BY 1), e AS (SELECT max(last_ts) AS latest FROM b) SELECT symbol, bars, {_NEED} AS bars_needed, bars < {_NEED} AS snooped, date_diff('day', last_ts, latest) > 5 AS ended FROM b, e")(
    lambda s, d: (b := curve(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("ts").alias("last_ts"))).select("symbol", "bars", F.lit(-(-_TRIALS * 20 // 1)).cast("long").alias("bars_needed"), (F.col("bars") < _TRIALS * 20).alias("snooped"), (F.datediff(b.agg(F.max("last_ts")).scalar(), "last_ts") > 5).alias("ended")))

# health by month and what its history says
_MONTHS = "symbol, month, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 9) AS sharpe, round(max(1 - equity / peak), 9) AS dd, count(*) AS freq"
_HIST = "symbol, month, sharpe, dd, freq, lead(sharpe, 1) OVER h AS s1, lead(sharpe, 2) OVER h AS s2, max(dd) OVER f AS worst, avg(freq) OVER f AS mean_freq, stddev_pop(freq) OVER f AS sd_freq, count(*) OVER f AS older, row_number() OVER h AS age"
_STATUS = "CASE WHEN sharpe <= 0 OR triggers >= 2 THEN 'ALERT' WHEN triggers >= 1 THEN 'WATCH' ELSE 'HEALTHY' END AS status"
_TRIG = "*, CAST(coalesce(sharpe < s1 AND s1 < s2, false) AS INT) + CAST(dd > coalesce(worst, 1) * 0.8 AS INT) + CAST(older >= 5 AND sd_freq > 0 AND abs(freq - mean_freq) > 2 * sd_freq AS INT) AS triggers"
query("status_rules", f"WITH {_CURVE}, m AS (SELECT symbol, date_trunc('month', ts)::DATE AS month, r, equity, peak FROM c1), a AS (SELECT {_MONTHS} FROM m GROUP BY symbol, month HAVING stddev_pop(r) > 0), b AS (SELECT {_HIST} FROM a WINDOW h AS (PARTITION BY symbol ORDER BY month DESC), f AS (PARTITION BY symbol ORDER BY month DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), c AS (SELECT {_TRIG.replace('0.8', '0.8e0')} FROM b) SELECT symbol, month, triggers, {_STATUS} FROM c")(
    lambda s, d: _status(s, d))


def _status(s, d):
    """Each month's health against all months before it."""
    months = M.curve(curve(s, d)).withColumn("month", F.trunc(F.to_date("ts"), "month")).groupBy("symbol", "month").agg(*[F.expr(x) for x in _split(_MONTHS)[2:]], F.stddev_pop("r").alias("sd")).filter("sd > 0")
    h = Window.partitionBy("symbol").orderBy(F.desc("month"))
    f = h.rowsBetween(1, Window.unboundedFollowing)
    rows = months.select("*", F.lead("sharpe", 1).over(h).alias("s1"), F.lead("sharpe", 2).over(h).alias("s2"), F.max("dd").over(f).alias("worst"), F.avg("freq").over(f).alias("mean_freq"), F.stddev_pop("freq").over(f).alias("sd_freq"), F.count("*").over(f).alias("older"))
    return rows.selectExpr(*_split(_TRIG.replace("0.8", "0.8D"))).selectExpr("symbol", "month", "triggers", _STATUS)


query("status_counts", "WITH x AS (SELECT c_mktsegment AS kernel, CASE c_custkey % 3 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'PAPER' ELSE 'RETIRED' END AS status FROM customer) SELECT kernel, count(*) FILTER (status = 'LIVE') AS live, count(*) FILTER (status = 'PAPER') AS paper, count(*) FILTER (status = 'RETIRED') AS retired FROM x GROUP BY 1")(
    lambda s, d: R.library(s, d).groupBy("kernel").agg(*[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("LIVE", "PAPER", "RETIRED")]))
query("strategies_by_status", "SELECT c_custkey AS id, c_mktsegment AS kernel FROM customer WHERE c_custkey % 3 = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")(
    lambda s, d: R.library(s, d).filter("status = 'PAPER'").orderBy(F.desc("gate"), "id").limit(50).select("id", "kernel"))
_LIB = "x AS (SELECT c_custkey AS id, c_mktsegment AS kernel, c_nationkey AS symbol, c_acctbal / 10000 AS gate, c_custkey % 3 AS s FROM customer), champ AS (SELECT kernel, symbol, min(id) AS id FROM x WHERE s = 0 GROUP BY 1, 2), c AS (SELECT x.* FROM x JOIN champ USING (kernel, symbol, id)), p AS (SELECT x.kernel, x.symbol, min(x.id) AS challenger FROM x JOIN c USING (kernel, symbol) WHERE x.s = 1 AND x.gate >= c.gate + 0.05 GROUP BY 1, 2)"
query("promotions", f"WITH {_LIB} SELECT p.kernel, p.symbol, challenger, c.id AS champion, round(x.gate - c.gate, 4) AS delta FROM p JOIN c USING (kernel, symbol) JOIN x ON x.id = challenger")(lambda s, d: rounded(R.promotions(R.library(s, d)), 4))
query("status_update", f"WITH {_LIB} SELECT x.id, CASE WHEN p.challenger = x.id THEN 'LIVE' WHEN c.id = x.id AND p.challenger IS NOT NULL THEN 'RETIRED' ELSE CASE x.s WHEN 0 THEN 'LIVE' WHEN 1 THEN 'PAPER' ELSE 'RETIRED' END END AS status FROM x LEFT JOIN p USING (kernel, symbol) LEFT JOIN c ON c.kernel = x.kernel AND c.symbol = x.symbol")(
    lambda s, d: R.promoted(R.library(s, d)))
query("history_newest", "SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")(
    lambda s, d: R.newest(s.read.parquet(f"{d}/events.parquet"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", F.from_json("props", "k BIGINT")["k"].alias("k")))
query("config_versions", "WITH x AS (SELECT user_id, event_id, ts, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, count(*) FILTER (props IS DISTINCT FROM was) AS versions, count(*) AS saves FROM x GROUP BY 1")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("was", F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).groupBy("user_id").agg(F.count_if(~F.col("props").eqNullSafe(F.col("was"))).alias("versions"), F.count("*").alias("saves")))
_BLEND = "symbol, month, round(avg(close) / 1000) AS p0, round(avg(high / low), 6) AS p1, greatest(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0), 0) AS sharpe"
query("param_blend", f"WITH {DAILY}, m AS (SELECT *, close / lag(close) OVER w - 1 AS r, date_trunc('month', ts)::DATE AS month FROM daily WINDOW {W}), a AS (SELECT {_BLEND} FROM m GROUP BY symbol, month), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) - 1 AS i FROM a), c AS (SELECT *, CASE WHEN i = 0 THEN 1 ELSE power(0.9, i - 1) END * (1 + sharpe) AS w FROM b WHERE i <= 12) SELECT symbol, round(sum(p0 * w) / sum(w))::BIGINT AS p0, round(sum(p1 * w) / sum(w), 6) AS p1 FROM c GROUP BY 1")(
    lambda s, d: R.blended(_monthly_params(s, d), ["symbol"], F.desc("month"), {"p0": True, "p1": False}, 12))


def _monthly_params(s, d):
    b = B.daily_bars(s, d).withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1).withColumn("month", F.trunc(F.to_date("ts"), "month"))
    return b.groupBy("symbol", "month").agg(*[F.expr(x) for x in _split(_BLEND)[2:]])


query("momentum_snapshot", f"WITH {DAILY}, x AS (SELECT symbol, ts, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) AS near_high, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS up_share FROM (SELECT *, close > lag(close) OVER w AS up FROM daily WINDOW {W})) SELECT symbol, ts, round(near_high, 6) AS near_high, round(up_share, 6) AS up_share FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")(
    lambda s, d: _momentum(s, d))


def _momentum(s, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    b = B.daily_bars(s, d).withColumn("up", F.when(F.col("close") > F.lag("close").over(w), 1.0).otherwise(0.0))
    x = b.select("symbol", "ts", (F.col("close") / F.max("close").over(w.rowsBetween(-59, 0))).alias("near_high"), F.avg("up").over(w.rowsBetween(-19, 0)).alias("up_share"))
    return rounded(B.keep_one(x, ["symbol"], [F.desc("ts")]))


# cost models and reference tables
# the little that is added keeps exact halves on one side
_SIZES = "ok, ln, lev, round(1e-10 + price * (1 + 5 * sqrt(lev) / 1e4), 7) AS buy_at, round(1e-10 + price * (1 - 5 * sqrt(lev) / 1e4), 7) AS sell_at, round(1e-10 + shares * price * 0.0002, 7) AS maker_fee, round(1e-10 + shares * price * 0.0004, 7) AS taker_fee, round(1e-10 + 0.0003 * CASE WHEN lev > 1 THEN lev * (1 + 0.02 * lev) ELSE 1 END, 7) AS funding, round(1e-10 + CASE symbol WHEN 'A' THEN 0.08 WHEN 'N' THEN 0.05 ELSE 0.03 END / 365, 7) AS borrow, round(1e-10 + shares * price * 0.5 * 0.0583 / 365, 7) AS margin_interest, round(1e-10 + 10 * power(least(1, shares / 100), 0.5) * greatest(0.25, least(4, price / 1500)), 7) AS impact_scaled, round(1e-10 + 0.02 * sqrt(shares / 100) + 0.1 * 0.02 * shares / 100, 7) AS impact_other"
query("cost_model", f"WITH {TRADES}, x AS (SELECT *, (ok % 3 * 2 + 1)::DOUBLE AS lev FROM trades) SELECT {R.exponents(_SIZES)} FROM x")(lambda s, d: trades(s, d).withColumn("lev", (F.col("ok") % 3 * 2 + 1).cast("double")).selectExpr(*_split(R.doubles(_SIZES))))
#: Upper bounds of notional, maintenance rates, and what they take off.
_TIER = [(5e4, 0.004, 0), (2.5e5, 0.005, 50), (1e6, 0.01, 1050), (1e7, 0.025, 16050), (2e7, 0.05, 266050), (5e7, 0.1, 1266050), (1e8, 0.125, 2516050), (2e8, 0.15, 5016050), (1e300, 0.25, 25016050)]
_MAINT = "CASE " + " ".join(f"WHEN {{0}} <= {a!r}e0 THEN {{0}} * {r!r}e0 - {m}" for a, r, m in _TIER) .replace("e+300e0", "e300").replace("1e300e0", "1e300") + " END"
_XM = "part, round(1000000 + sum(qty * (last - entry)) - sum(" + _MAINT.format("abs(qty * last)") + "), 4) AS available"
query("cross_margin", f"WITH x AS (SELECT l_partkey AS part, l_returnflag AS symbol, sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE -l_quantity END) AS qty, avg(l_extendedprice / l_quantity) AS entry, max(l_extendedprice / l_quantity) AS last FROM lineitem GROUP BY 1, 2) SELECT {_XM} FROM x GROUP BY part")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("symbol")).agg(F.expr("sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE -l_quantity END) AS qty"), F.expr("avg(l_extendedprice / l_quantity) AS entry"), F.expr("max(l_extendedprice / l_quantity) AS last")).groupBy("part").agg(F.expr(_split(_XM)[1])))
#: Endings of crypto symbols.
CRYPTO = ["USDT", "BUSD", "BTC", "ETH", "BNB", "USDC"]
_SYM = "upper(replace(n_name, ' ', '')) || CASE n_nationkey % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BTC' WHEN 2 THEN 'usdc' ELSE '' END"
query("symbol_class", f"WITH x AS (SELECT {_SYM} AS symbol FROM nation) SELECT symbol, regexp_matches(upper(symbol), '({'|'.join(CRYPTO)})$') AS crypto, regexp_replace(upper(symbol), '({'|'.join(CRYPTO)})$', '') AS prefix FROM x")(
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").selectExpr(f"{_SYM} AS symbol").select("symbol", F.upper("symbol").rlike(f"({'|'.join(CRYPTO)})$").alias("crypto"), F.regexp_replace(F.upper("symbol"), f"({'|'.join(CRYPTO)})$", "").alias("prefix")))
query("interval_facts", "SELECT name, rank, seconds, (86400 // seconds)::INT AS bars_per_day, (365 * 86400 // seconds)::INT AS bars_per_year FROM (VALUES " + ", ".join(f"('{n}', {k}, {x})" for k, (n, x) in enumerate(R.INTERVALS.items())) + ") t(name, rank, seconds)")(lambda s, d: R.intervals(s))
query("presets", "SELECT * FROM (VALUES ('conservative', 0.0015, 5.0, 0.0, 0.0), ('crypto', 0.0004, 3.0, 0.0003, 0.0), ('equity', 0.0005, 5.0, 0.0, 0.03)) t(name, commission, slippage_bps, daily_funding, borrow_annual)".replace("SELECT *", "SELECT name, commission::DOUBLE AS commission, slippage_bps::DOUBLE AS slippage_bps, daily_funding::DOUBLE AS daily_funding, borrow_annual::DOUBLE AS borrow_annual"))(lambda s, d: R.presets(s))

# small things about rows: defaults, signals, sizes, text
query("column_defaults", f"WITH {bars_cte()}, x AS (SELECT symbol, ts, CASE WHEN hour(ts) % 8 = 0 THEN NULL ELSE open END AS open, high, close FROM bars) SELECT symbol, ts, round(coalesce(open, close), 6) AS open, round(coalesce(high, close), 6) AS high, round(close, 6) AS close FROM x")(
    lambda s, d: rounded(B.defaulted(B.bars_of(s, d).withColumn("open", F.when(F.hour("ts") % 8 != 0, F.col("open"))).drop("low", "volume")).select("symbol", "ts", "open", "high", "close")))
query("signals_normalised", "SELECT event_id, CASE lower(event_type) WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' WHEN 'click' THEN 'cancel' END AS action FROM events WHERE lower(event_type) IN ('purchase', 'error', 'click')")(
    lambda s, d: R.signals(s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'Sell' WHEN 'click' THEN 'cancel' ELSE 'hold' END AS action"))))
_SIZE = "symbol, ts, CAST(floor(100000 * 0.95 / close) AS BIGINT) AS by_fraction, CAST(floor(least(100000 * 0.02 / greatest(vol * sqrt(252), 0.01), 95000) / close) AS BIGINT) AS by_vol"
query("position_sizes", f"WITH {DAILY}, x AS (SELECT symbol, ts, close / 1000 AS close, r, row_number() OVER w AS rn FROM (SELECT *, close / lag(close) OVER w - 1 AS r FROM daily WINDOW {W}) WINDOW {W}), v AS (SELECT symbol, ts, close, rn, round(stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 9) AS vol FROM x) SELECT {R.exponents(_SIZE)} FROM v WHERE rn > 20")(
    lambda s, d: _sizes(s, d))


def _sizes(s, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    x = B.daily_bars(s, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("close", F.col("close") / 1000).withColumn("rn", F.row_number().over(w))
    return x.withColumn("vol", F.round(F.stddev_pop("r").over(w.rowsBetween(-19, 0)), 9)).filter("rn > 20").selectExpr(*_split(R.doubles(_SIZE)))


_HIGH, _MID = R.HIGH_VALUE, R.MEDIUM_VALUE
_HAS = lambda words, one: " + ".join(f"CASE WHEN contains(t, '{w}') THEN {one} ELSE 0 END" for w in words)
_LEVEL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{level}'" for level, words in R.COMPLEXITY) + " ELSE 'MEDIUM' END"
query("keyword_score", f"WITH x AS (SELECT p_partkey, lower(p_name || ' momentum ' || CASE p_partkey % 4 WHEN 0 THEN 'backtest of a deep learning alpha' WHEN 1 THEN 'sharpe portfolio return prediction' WHEN 2 THEN 'gradient boosting' ELSE 'lstm' END) AS t FROM part) SELECT p_partkey, CAST(least(5, floor(1 + {_HAS(_HIGH, 1)} + {_HAS(_MID, '0.5')})) AS INT) AS score, {_LEVEL} AS level FROM x")(
    lambda s, d: R.scored(s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "lower(p_name || ' momentum ' || CASE p_partkey % 4 WHEN 0 THEN 'backtest of a deep learning alpha' WHEN 1 THEN 'sharpe portfolio return prediction' WHEN 2 THEN 'gradient boosting' ELSE 'lstm' END) AS t"), "t").select("p_partkey", "score", "level"))
_SPARK = f"list_aggregate(list_transform(v, lambda x: substr('{R.SPARKS}', CAST(least(floor((x - lo) / (hi - lo) * 7), 7) AS INT) + 1, 1)), 'string_agg', '')"
query("sparkline", f"WITH {DAILY}, m AS (SELECT symbol, date_trunc('month', ts) AS month, arg_max(close, ts) AS c FROM daily GROUP BY 1, 2), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY month DESC) <= 8), a AS (SELECT symbol, list(c ORDER BY month) AS v, min(c) AS lo, max(c) AS hi FROM t GROUP BY 1) SELECT symbol, {_SPARK} AS line, CASE WHEN abs(v[-1] - v[1]) < 0.01 THEN '→' WHEN v[-1] > v[1] THEN '↗' ELSE '↘' END AS arrow FROM a")(
    lambda s, d: R.sparklines(B.daily_bars(s, d).groupBy("symbol", F.trunc(F.to_date("ts"), "month").alias("month")).agg(F.max_by("close", "ts").alias("c")), "month", "c", 8))
# fixed values: the limits of each flag
_FLAGS = "symbol, abs(recent - whole) > 0.15 AS ac, vr > 1.5 AS expanding, vr < 0.6 AS contracting, abs(rs - ws) > 0.5 AS skew"
_TEXT = "concat_ws('; ', CASE WHEN ac THEN 're-evaluate strategy type selection' END, CASE WHEN expanding THEN 'consider reducing position size or leverage' END, CASE WHEN contracting THEN 'mean-reversion strategies may outperform' END, CASE WHEN skew THEN 'check tail risk and stop-loss adequacy' END)"
_SKEW = "(avg({0} * {0} * {0}) - 3 * avg({0}) * avg({0} * {0}) + 2 * power(avg({0}), 3)) / power(stddev_pop({0}), 3)"
query("anomaly_text", f"WITH {DAILY}, a AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM daily WINDOW {W}), b AS (SELECT *, lag(r) OVER w AS pr, CASE WHEN back <= 60 THEN r END AS late FROM a WINDOW {W}), c AS (SELECT symbol, corr(r, pr) AS whole, corr(late, pr) AS recent, stddev_pop(late) / stddev_pop(r) AS vr, {_SKEW.format('late')} AS rs, {_SKEW.format('r')} AS ws FROM b GROUP BY 1), f AS (SELECT {_FLAGS} FROM c) SELECT symbol, symbol || ': ' || coalesce(nullif({_TEXT}, ''), 'review strategy parameters') AS advice FROM f")(
    lambda s, d: _advice(s, d))


def _advice(s, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    a = B.daily_bars(s, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    b = a.withColumn("pr", F.lag("r").over(w)).withColumn("late", F.when(F.col("back") <= 60, F.col("r")))
    c = b.groupBy("symbol").agg(F.corr("r", "pr").alias("whole"), F.corr("late", "pr").alias("recent"), (F.stddev_pop("late") / F.stddev_pop("r")).alias("vr"), F.skewness("late").alias("rs"), F.skewness("r").alias("ws"))
    return c.selectExpr(*_split(R.doubles(_FLAGS))).select("symbol", F.concat("symbol", F.lit(": "), F.coalesce(F.expr(f"nullif({_TEXT}, '')"), F.lit("review strategy parameters"))).alias("advice"))


query("viable_strategies", f"WITH {_CURVE}, s AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg((r > 0)::INT) AS positive, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS ret, min(dd) AS dd FROM c1 GROUP BY 1) SELECT symbol FROM s WHERE sharpe > 0.3 AND positive > 0.3 AND ret > -0.9 AND dd < 0")(
    lambda s, d: M.curve(curve(s, d)).groupBy("symbol").agg((F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252))).alias("sharpe"), F.expr("avg(CASE WHEN r > 0 THEN 1D WHEN r IS NOT NULL THEN 0D END) AS positive"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("ret"), F.min(F.col("equity") / F.col("peak") - 1).alias("dd")).filter("sharpe > 0.3 AND positive > 0.3 AND ret > -0.9 AND dd < 0").select("symbol"))
# rank correlations of features, whole and rolling
_FEATS = {"ret": "close / lag(close) OVER w - 1", "range": "(high - low) / close", "volume": "volume", "body": "close - open"}
_FR = f"{bars_cte()}, f AS (SELECT symbol, ts, " + ", ".join(f"round({x}, 9) AS {k}" for k, x in _FEATS.items()) + f", round(lead(close) OVER w / close - 1, 9) AS fwd FROM bars WINDOW {W}), g AS (SELECT * FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL)"
_LONG = " UNION ALL ".join(f"SELECT symbol, '{k}' AS name, ts, row_number() OVER (PARTITION BY symbol ORDER BY {k}, ts) AS rank FROM g" for k in _FEATS)
query("spearman_matrix", f"WITH {_FR}, l AS ({_LONG}) SELECT a.symbol, a.name AS a, b.name AS b, round(corr(a.rank, b.rank), 6) AS corr FROM l a JOIN l b ON a.symbol = b.symbol AND a.ts = b.ts AND a.name < b.name GROUP BY 1, 2, 3")(
    lambda s, d: rounded(R.spearman_matrix(_features(s, d), list(_FEATS))))


def _features(s, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    b = B.bars_of(s, d)
    f = b.select("symbol", "ts", F.round(F.col("close") / F.lag("close").over(w) - 1, 9).alias("ret"), F.round(F.expr("(high - low) / close"), 9).alias("range"), F.round("volume", 9).alias("volume"), F.round(F.expr("close - open"), 9).alias("body"), F.round(F.lead("close").over(w) / F.col("close") - 1, 9).alias("fwd"))
    return f.filter("ret IS NOT NULL AND fwd IS NOT NULL")


_ROLL = f"""WITH {_FR}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM g), v AS (SELECT i.symbol, i.rn AS bar, x.name, x.value, x.fwd, x.rn FROM n i JOIN (
    {" UNION ALL ".join(f"SELECT symbol, rn, '{k}' AS name, {k} AS value, fwd FROM n" for k in _FEATS)}) x ON x.symbol = i.symbol AND x.rn BETWEEN i.rn - 60 AND i.rn - 1 WHERE i.rn > 60),
  k AS (SELECT symbol, name, bar, row_number() OVER (PARTITION BY symbol, name, bar ORDER BY value, rn) AS a, row_number() OVER (PARTITION BY symbol, name, bar ORDER BY fwd, rn) AS b FROM v),
  c AS (SELECT symbol, name, bar, corr(a, b) AS ic FROM k GROUP BY 1, 2, 3)
  SELECT symbol, name, round(avg(ic), 6) AS ic_mean, round(stddev_pop(ic), 6) AS ic_std, round(avg(ic) / stddev_pop(ic), 4) AS icir, round(arg_max(ic, bar), 6) AS ic_last FROM c GROUP BY 1, 2 HAVING count(*) >= 3"""
query("rolling_ic", _ROLL)(lambda s, d: R.rolling_ic(_features(s, d), list(_FEATS), "fwd", 60).select("symbol", "name", F.round("ic_mean", 6).alias("ic_mean"), F.round("ic_std", 6).alias("ic_std"), F.round("icir", 4).alias("icir"), F.round("ic_last", 6).alias("ic_last")))
query("orthogonal_features")(lambda s, d: R.orthogonal(R.rolling_ic(_features(s, d), list(_FEATS), "fwd", 60), R.spearman_matrix(_features(s, d), list(_FEATS)), 0.7, 0.0))
