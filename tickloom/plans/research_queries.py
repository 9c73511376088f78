"""Files, streams, documents, fusion, validation, simulator and research queries, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from dateutil.easter import easter
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import documents as D
from tickloom.operators import pairs, simulator, validation
from tickloom.sources import files
from tickloom.streaming import bars as S

from .analytics_queries import _split, default_grid, trades
from .bar_queries import R4, asof, rounded
from .bar_queries import shared as _shared
from .oracle import DAILY, TICKS, TRADES, W, bars_cte, frame

QUERIES: dict = {}
SQL: dict = {}


def w():
    return Window.partitionBy("symbol").orderBy("ts")


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


# files: prices as 32-bit floats, or as they are
_F4 = ", ".join(f"round({c}::FLOAT::DOUBLE, 4) AS {c}" for c in files.PRICES)
query("scan_binary", f"WITH {bars_cte()} SELECT symbol, ts, {_F4} FROM bars WHERE ts >= TIMESTAMP '2024-01-10'")(lambda s, d: rounded(files.between(files.from_binary(files.to_binary(B.bars_of(s, d))), "2024-01-10"), 4))
query("scan_arrow", f"WITH {bars_cte()} SELECT symbol, ts, {R4} FROM bars WHERE ts <= TIMESTAMP '2024-01-20'")(lambda s, d: rounded(files.between(files.from_arrow(files.to_arrow(B.bars_of(s, d))), end="2024-01-20")))


# streams: all that is there, run to its end
def _streamed(s, d, build, mode="append"):
    at = _shared(s)
    e = S.read(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    out = build(e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq")))
    S.run_to(out, f"{at}/out", f"{at}/state", mode)
    return S.result(s, f"{at}/out", out.schema)


query("stream_bars", f"WITH {bars_cte()} SELECT symbol, ts::TIMESTAMP AS ts, {R4} FROM bars")(lambda s, d: rounded(_streamed(s, d, lambda t: S.tumbling(t, "4 hours"), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
query("stream_in_order", f"""WITH t AS ({TICKS}), k AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t)
  SELECT symbol, ts, round(price, 6) AS price, last IS NOT NULL AND epoch_us(ts) - epoch_us(last) > 5400000000 AS gap FROM k WHERE last IS NULL OR ts > last""")(lambda s, d: rounded(_streamed(s, d, lambda t: S.in_order(t, 3600))))
query("sliding_bars", f"""WITH t AS ({TICKS}), x AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) - to_hours(k::INT) AS ts, price FROM t, range(4) r(k))
  SELECT symbol, ts, count(*) AS n, round(max(price), 6) AS high, round(min(price), 6) AS low FROM x GROUP BY 1, 2""")(
    lambda s, d: rounded(B.ticks(s, d).groupBy("symbol", F.window("ts", "4 hours", "1 hour").alias("x")).agg(F.count("*").alias("n"), F.max("price").alias("high"), F.min("price").alias("low")).select("symbol", F.col("x.start").cast("timestamp_ntz").alias("ts"), "n", "high", "low")))

# positions by interval, aligned to the finest, fused
_POS = "CASE WHEN row_number() OVER w >= 20 THEN sign(round(avg(close) OVER {0} - avg(close) OVER {1}, 9)) ELSE 0 END"


def _positions(s, d, every):
    at = [F.avg("close").over(w().rowsBetween(1 - n, 0)) for n in (5, 20)]
    return B.bars_of(s, d, every).select("symbol", "ts", F.when(F.row_number().over(w()) >= 20, F.signum(F.round(at[0] - at[1], 9))).otherwise(0.0).alias("pos"))


def _fused(s, d):
    grid = _positions(s, d, "1 hour").withColumnRenamed("pos", "p1")
    for name, every in (("p4", "4 hours"), ("p24", "1 day")):
        grid = asof(grid, _positions(s, d, every).withColumnRenamed("pos", name), name).withColumn(name, F.coalesce(name, F.lit(0.0)))
    return grid


fused = _fused


def fusion_ctes() -> str:
    """CTEs up to ``g``: (symbol, ts, p1, p4, p24) on the one-hour bars ``b1``."""
    parts = ", ".join(f"{bars_cte(e, 'b' + n)}, q{n} AS (SELECT symbol, ts, {_POS.format(frame(5), frame(20))} AS pos FROM b{n} WINDOW {W})" for n, e in (("1", "1 hour"), ("4", "4 hours"), ("24", "1 day")))
    return f"{parts}, g AS (SELECT q1.symbol, q1.ts, q1.pos AS p1, coalesce(q4.pos, 0) AS p4, coalesce(q24.pos, 0) AS p24 FROM q1 ASOF LEFT JOIN q4 ON q1.symbol = q4.symbol AND q1.ts >= q4.ts ASOF LEFT JOIN q24 ON q1.symbol = q24.symbol AND q1.ts >= q24.ts)"


_VOTES = "CAST(p1 {0} 0 AS INT) + CAST(p4 {0} 0 AS INT) + CAST(p24 {0} 0 AS INT) > 1.5"
#: Ways to fuse positions: the coarsest gives the trend, a majority, or one interval alone.
FUSIONS = [
    ("fusion_trend", "CASE WHEN p24 > 0 AND p1 > 0 THEN 1 WHEN p24 < 0 AND p1 < 0 THEN -1 ELSE 0 END"),
    ("fusion_consensus", f"CASE WHEN {_VOTES.format('>')} THEN 1 WHEN {_VOTES.format('<')} THEN -1 ELSE 0 END"),
    ("fusion_primary", "p4"),
]
for name, expr in FUSIONS:
    query(name, f"WITH {fusion_ctes()} SELECT symbol, ts, CAST({expr} AS INT) AS pos FROM g")(lambda s, d, expr=expr: _fused(s, d).selectExpr("symbol", "ts", f"CAST({expr} AS INT) AS pos"))
_CHANGE = "CASE WHEN pos > was THEN 'buy' ELSE 'sell' END AS action, CASE WHEN pos = 0 THEN 'close' WHEN was = 0 THEN 'open' ELSE 'reverse' END AS intent"
query("position_change", f"WITH {bars_cte()}, q AS (SELECT symbol, ts, {_POS.format(frame(5), frame(20))} AS pos FROM bars WINDOW {W}), c AS (SELECT *, lag(pos, 1, 0) OVER w AS was FROM q WINDOW {W}) SELECT symbol, ts, {_CHANGE} FROM c WHERE pos <> was")(
    lambda s, d: _positions(s, d, "4 hours").withColumn("was", F.lag("pos", 1, 0.0).over(w())).filter("pos <> was").selectExpr("symbol", "ts", *_split(_CHANGE)))

# costs, rounding, fills, margin, calendar
_IMPACT = "round(CASE side WHEN 'buy' THEN 1 ELSE -1 END * 10 * sqrt(least(1, shares / 100)), 6) AS impact_bps"
query("market_impact", f"WITH {TRADES} SELECT ok, ln, {_IMPACT} FROM trades")(lambda s, d: trades(s, d).selectExpr("ok", "ln", _IMPACT))
_PROB = "CASE WHEN high - low < 1e-10 THEN 1 ELSE 0.3 + 0.7 * greatest(0, least(1, (lp - low) / (high - low))) END"
_LIMIT = f"round({_PROB}, 6) AS chance, round(CASE WHEN low <= lp AND round({_PROB}, 6) >= 0.5 THEN least(open, lp) END, 6) AS fill"
query("limit_fills", f"WITH {bars_cte()}, x AS (SELECT *, (open + low) / 2 AS lp FROM bars) SELECT symbol, ts, {_LIMIT} FROM x")(lambda s, d: B.bars_of(s, d).withColumn("lp", F.expr("(open + low) / 2")).selectExpr("symbol", "ts", *_split(_LIMIT.replace("0.3 + 0.7", "0.3D + 0.7D"))))
_LOT = "round(floor(price / 0.05{0} + 0.5{0}) * 0.05{0}, 6) AS tick_price, round(floor(shares / 3) * 3, 6) AS lot, CASE WHEN shares < 3 THEN 'min_qty' WHEN shares > 45 THEN 'max_qty' WHEN shares * price < 5000 THEN 'min_notional' END AS refused"
#: Spark's floor is a long, so prices that have no fraction (infinite ones too) go without it.
_TICKS = "floor(price / 0.05D + 0.5D)"
query("order_rounding", f"WITH {TRADES} SELECT ok, ln, {_LOT.format('::DOUBLE')} FROM trades")(lambda s, d: trades(s, d).selectExpr("ok", "ln", *_split(_LOT.format("D").replace("floor(shares / 3) * 3", "CAST(floor(shares / 3) * 3 AS DOUBLE)").replace(_TICKS, f"if(abs(price) < 1e15D, {_TICKS}, price / 0.05D + 0.5D)"))))
query("reg_t_margin", f"WITH {TRADES} SELECT ok, ln, round(shares * price * 0.5, 6) AS initial, round(shares * price * 0.25, 6) AS maintenance, commission * 4 < shares * price * 0.25 AS margin_call FROM trades")(
    lambda s, d: trades(s, d).select("ok", "ln", F.round(F.expr("shares * price * 0.5D"), 6).alias("initial"), F.round(F.expr("shares * price * 0.25D"), 6).alias("maintenance"), F.expr("commission * 4 < shares * price * 0.25D").alias("margin_call")))
#: Good Fridays by rule; the other holidays are days of a month or the n-th weekday of one.
FRIDAYS = ", ".join(f"DATE '{easter(y) - timedelta(2)}'" for y in range(1990, 2041))
_FREE = "(strftime({0}, '%m-%d') IN ('01-01', '06-19', '07-04', '12-25') OR {0} IN (" + FRIDAYS + ") OR isodow({0}) = 1 AND (month({0}) IN (1, 2) AND day({0}) BETWEEN 15 AND 21 OR month({0}) = 5 AND day({0}) >= 25 OR month({0}) = 9 AND day({0}) <= 7) OR isodow({0}) = 4 AND month({0}) = 11 AND day({0}) BETWEEN 22 AND 28)"
_FREE_SPARK = _FREE.replace("strftime({0}, '%m-%d')", "date_format({0}, 'MM-dd')").replace("isodow({0})", "(weekday({0}) + 1)")
query("us_holidays", f"WITH x AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, {_FREE.format('day')} AS holiday, isodow(day) <= 5 AND NOT {_FREE.format('day')} AS trading FROM x")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct().selectExpr("day", f"{_FREE_SPARK.format('day')} AS holiday", f"weekday(day) < 5 AND NOT {_FREE_SPARK.format('day')} AS trading"))
query("us_session", f"""WITH x AS (SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS et FROM events)
  SELECT et::DATE AS day, count(*) AS n FROM x WHERE isodow(et::DATE) <= 5 AND NOT {_FREE.format('et::DATE')} AND hour(et) * 3600 + minute(et) * 60 + epoch(et) % 60 BETWEEN 34200 AND 57600 GROUP BY 1""")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "ts").alias("et")).withColumn("day", F.to_date("et")).filter(f"weekday(day) < 5 AND NOT {_FREE_SPARK.format('day')} AND hour(et) * 3600 + minute(et) * 60 + extract(SECOND FROM et) BETWEEN 34200 AND 57600").groupBy("day").agg(F.count("*").alias("n")))

# research over daily returns
_R = f"{DAILY}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM daily WINDOW {W})"


def _r(s, d):
    return B.daily_bars(s, d).withColumn("r", F.col("close") / F.lag("close").over(w()) - 1).withColumn("rn", F.row_number().over(w())).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("peak", F.max("close").over(w().rowsBetween(Window.unboundedPreceding, 0)))


_M = "symbol, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe, stddev_pop(r) * sqrt(252) AS vol, min(close / peak - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) * 100 AS win, sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END) AS pf, sum(CASE WHEN rn > 0.8 * n THEN r END) AS late"


def _metrics(s, d):
    parts = _split(_M.replace("0.8 * n", "0.8D * n").replace("1.0 ", "1.0D ").replace("0.0 END", "0.0D END"))
    return _r(s, d).groupBy("symbol").agg(*[F.expr(x) for x in parts[1:]])


#: Weights of the six parts of the gate.
GATE = {"statistical": 0.25, "walkforward": 0.20, "neighborhood": 0.20, "montecarlo": 0.15, "deflated": 0.10, "tail_risk": 0.10}
# p stands for the deflated Sharpe p-value, given here by a rule of the Sharpe ratio; shares are fractions
_GATE = f"""round({GATE['statistical']}e0 * (0.6e0 * greatest(0e0, least(1e0, sharpe / 3)) + 0.4e0 * (1 - p)) + {GATE['walkforward']}e0 * (0.7e0 * greatest(0e0, least(1e0, pf / 2)) + 0.3e0 * greatest(0e0, least(1e0, late / 0.5e0)))
  + {GATE['neighborhood']}e0 * 0.5e0 + {GATE['montecarlo']}e0 * least(1e0, win / 100) + {GATE['deflated']}e0 * greatest(0e0, 1 - 2 * p) + {GATE['tail_risk']}e0 * (0.6e0 * greatest(0e0, 1 - abs(dd) / 0.5e0) + 0.4e0), 6) AS gate"""
query("gate_score", f"WITH {_R}, m AS (SELECT {_M} FROM r GROUP BY symbol), x AS (SELECT *, 1 / (1 + exp(sharpe)) AS p FROM m) SELECT symbol, {_GATE} FROM x")(lambda s, d: _metrics(s, d).withColumn("p", F.expr("1 / (1 + exp(sharpe))")).selectExpr("symbol", _GATE))
_COMPOSITE = "round(40 * tanh(sharpe / 3) + 25 * tanh(late / 30) + 20 * tanh((win - 50) / 20) + 15 * tanh((pf - 1) / 1.2e0), 6) AS score, round(greatest(0e0, 100 + 400 * dd), 6) AS stability"
query("composite_score", f"WITH {_R}, m AS (SELECT {_M} FROM r GROUP BY symbol) SELECT symbol, {_COMPOSITE} FROM m")(lambda s, d: _metrics(s, d).selectExpr("symbol", *_split(_COMPOSITE)))
_BETA = "round(covar_samp(r, m) / var_samp(m), 6) AS beta, round(avg(r) - covar_samp(r, m) / var_samp(m) * avg(m), 6) AS alpha, round(corr(r, m), 6) AS market_corr"
query("beta_attribution", f"WITH {_R}, x AS (SELECT symbol, r, avg(r) OVER (PARTITION BY ts) AS m FROM r WHERE r IS NOT NULL) SELECT symbol, {_BETA} FROM x GROUP BY 1")(
    lambda s, d: _r(s, d).filter("r IS NOT NULL").withColumn("m", F.avg("r").over(Window.partitionBy("ts"))).groupBy("symbol").agg(*[F.expr(x) for x in _split(_BETA)]))
_PAIRS = "j AS (SELECT a.symbol AS a, b.symbol AS b, a.r AS ra, b.r AS rb, a.rn > a.n - 250 AS late FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"


def _pairs(s, d):
    """Correlations over all times and over those of the last 250 days of the first symbol."""
    return pairs.correlations(_r(s, d).withColumn("late", F.expr("rn > n - 250")), "r", "late")


query("corr_shift", f"WITH {_R}, {_PAIRS} SELECT a, b, round(corr(ra, rb), 6) AS every, round(corr(CASE WHEN late THEN ra END, CASE WHEN late THEN rb END), 6) AS recent FROM j GROUP BY 1, 2")(
    lambda s, d: rounded(_pairs(s, d).selectExpr("a", "b", "corr AS every", "corr_f AS recent")))
# the pair's worse side by Sharpe ratio is halved where they move together
_WEIGHTS = """m AS (SELECT symbol, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe, stddev_pop(r) * sqrt(252) AS vol FROM r GROUP BY symbol),
  c AS (SELECT a, b FROM j GROUP BY a, b HAVING abs(corr(ra, rb)) > 0.05e0),
  worse AS (SELECT CASE WHEN x.sharpe < y.sharpe THEN a ELSE b END AS symbol FROM c JOIN m x ON x.symbol = a JOIN m y ON y.symbol = b),
  k AS (SELECT symbol, count(*) AS k FROM worse GROUP BY symbol), u AS (SELECT m.symbol, greatest(sharpe, 0.01e0) / vol * power(0.5e0, coalesce(k, 0)) AS u FROM m LEFT JOIN k ON m.symbol = k.symbol)
  SELECT symbol, round(u / sum(u) OVER (), 4) AS weight FROM u"""


@query("portfolio_weights", f"WITH {_R}, {_PAIRS}, {_WEIGHTS}")
def portfolio_weights(s, d):
    """One row per symbol at the end, so the sum over all rows is over a handful."""
    m = _metrics(s, d).select("symbol", "sharpe", "vol")
    c = pairs.correlations(_r(s, d), "r").filter("abs(corr) > 0.05D")
    worse = c.join(m.selectExpr("symbol AS a", "sharpe AS sa"), "a").join(m.selectExpr("symbol AS b", "sharpe AS sb"), "b").selectExpr("CASE WHEN sa < sb THEN a ELSE b END AS symbol").groupBy("symbol").agg(F.count("*").alias("k"))
    u = m.join(worse, "symbol", "left").selectExpr("symbol", "greatest(sharpe, 0.01D) / vol * power(0.5D, coalesce(k, 0)) AS u")
    return u.select("symbol", F.round(F.col("u") / u.agg(F.sum("u")).scalar(), 4).alias("weight"))


_PORT = "count(*) AS n, round(avg(p) / stddev_pop(p) * sqrt(252), 6) AS sharpe, round(stddev_pop(p) * sqrt(252), 6) AS vol, round(min(p), 6) AS worst, round(exp(sum(ln(1 + p / 100))) - 1, 6) AS total"
query("portfolio_metrics", f"WITH {_R}, p AS (SELECT ts, avg(r) AS p FROM r WHERE r IS NOT NULL GROUP BY ts) SELECT {_PORT} FROM p")(
    lambda s, d: _r(s, d).filter("r IS NOT NULL").groupBy("ts").agg(F.avg("r").alias("p")).agg(*[F.expr(x) for x in _split(_PORT)]))
query("half_kelly", f"WITH {_R} SELECT symbol, round(CASE WHEN count(r) >= 30 THEN greatest(0, least(20, avg(r) / var_pop(r) / 2)) END, 6) AS kelly FROM r GROUP BY 1")(lambda s, d: _r(s, d).groupBy("symbol").agg(F.round(F.expr("CASE WHEN count(r) >= 30 THEN greatest(0D, least(20D, avg(r) / var_pop(r) / 2)) END"), 6).alias("kelly")))
query("survivorship", f"WITH {_R}, x AS (SELECT symbol, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY 1) SELECT symbol, last_ts, n, date_diff('day', last_ts, max(last_ts) OVER ()) > 5 AS ended FROM x")(
    lambda s, d: (x := _r(s, d).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))).select("symbol", "last_ts", "n", (F.datediff(x.agg(F.max("last_ts")).scalar(), "last_ts") > 5).alias("ended")))
query("spearman_ic", f"""WITH {_R}, f AS (SELECT symbol, r, lead(r) OVER w AS fwd FROM r WINDOW {W}), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / 2 AS b FROM f WHERE r IS NOT NULL AND fwd IS NOT NULL)
  SELECT symbol, round(corr(a, b), 6) AS ic FROM k GROUP BY 1""")(lambda s, d: _ic(_r(s, d).withColumn("fwd", F.lead("r").over(w())).filter("r IS NOT NULL AND fwd IS NOT NULL")))


def _ic(f):
    def ranks(c):
        return F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2

    return f.select("symbol", ranks("r").alias("a"), ranks("fwd").alias("b")).groupBy("symbol").agg(F.round(F.corr("a", "b"), 6).alias("ic"))


_SIG = "1 / (1 + exp(-greatest(-500e0, least(500e0, ({0} - ({1})) / {2}))))"
_RAW = ", ".join(f"{_SIG.format(x, a, b)} AS {n}" for n, x, a, b in (("t", "adx", "25", "10"), ("m", "-adx", "-20", "10"), ("v", "ratio", "1.3e0", "0.3e0"), ("c", "-band", "-0.02e0", "0.01e0")))
_REGIME_X = "symbol, max(n) AS n, 100 * abs(sum(up) - sum(down)) / greatest(sum(up) + sum(down), 1e-12) AS adx, stddev_pop(CASE WHEN rn > n - 20 THEN lr END) / greatest(stddev_pop(lr), 1e-12) AS ratio, stddev_pop(CASE WHEN rn > n - 20 THEN close END) / avg(CASE WHEN rn > n - 20 THEN close END) AS band"
_REGIME_T = "symbol, n, rn, close, CASE WHEN rn > n - 59 THEN ln(close / pc) END AS lr, CASE WHEN rn > n - 14 THEN greatest(high - ph, 0e0) END AS up, CASE WHEN rn > n - 14 THEN greatest(pl - low, 0e0) END AS down"
_REGIME = ", ".join(f"CASE WHEN n < 61 THEN 0.25e0 ELSE round({c} / (t + m + v + c), 4) END AS {name}" for c, name in (("t", "trending"), ("m", "mean_reverting"), ("v", "high_vol"), ("c", "compression")))

@query("regime", f"WITH {_R}, l AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM r WINDOW {W}), t AS (SELECT {_REGIME_T} FROM l WHERE rn > n - 60), x AS (SELECT {_REGIME_X} FROM t GROUP BY symbol), y AS (SELECT symbol, n, {_RAW} FROM x) SELECT symbol, {_REGIME} FROM y")
def _regime(s, d):
    lagged = _r(s, d).select("*", *[F.lag(c).over(w()).alias(n) for c, n in (("close", "pc"), ("high", "ph"), ("low", "pl"))])
    tail = lagged.filter("rn > n - 60").selectExpr(*_split(_REGIME_T))
    x = tail.groupBy("symbol").agg(*[F.expr(e) for e in _split(_REGIME_X)[1:]])
    return x.selectExpr("symbol", "n", *_split(_RAW)).selectExpr("symbol", *_split(_REGIME))


# documents
_docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
_NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
query("text_normalise", f"WITH x AS (SELECT doc_id, {_NORM} AS t FROM documents) SELECT doc_id, sha256(t) AS digest, length(t)::INT AS n FROM x WHERE length(t) >= 10")(
    lambda s, d: _docs(s, d).select("doc_id", D.normalised(F.col("text")).alias("t")).filter("length(t) >= 10").select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n")))
query("metadata_filter", "WITH x AS (SELECT doc_id, source, CASE WHEN doc_id % 7 > 0 THEN DATE '2024-01-01' + doc_id::INT END AS created FROM documents) SELECT doc_id, source FROM x WHERE contains(source, '1') AND (created IS NULL OR created < DATE '2024-06-01')")(
    lambda s, d: _docs(s, d).selectExpr("doc_id", "source", "CASE WHEN doc_id % 7 > 0 THEN date_add(DATE '2024-01-01', CAST(doc_id AS INT)) END AS created").filter("contains(source, '1') AND (created IS NULL OR created < DATE '2024-06-01')").select("doc_id", "source"))
query("context_concat", """WITH k AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents WHERE text IS NOT NULL), b AS (SELECT source, rank, '[' || rank || '] ' || text || chr(10) AS block FROM k WHERE rank <= 20),
  e AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY rank) AS e FROM b) SELECT source, count(*) AS blocks, sha256(string_agg(block, chr(10) ORDER BY rank)) AS digest FROM e WHERE e <= 4000 GROUP BY 1""")(
    lambda s, d: D.contexts(_docs(s, d).filter("text IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))).filter("rank <= 20").select("source", "rank", "text"), "source", 4000).select("source", "blocks", F.sha2("context", 256).alias("digest")))
query("merge_adjacent", "WITH c AS (SELECT doc_id, i AS idx FROM (SELECT doc_id, unnest(range((length(text) + 399) // 400)) AS i FROM documents WHERE text IS NOT NULL) WHERE (i + doc_id) % 4 <> 3), g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM c) SELECT doc_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY doc_id, g")(
    lambda s, d: D.runs(_docs(s, d).filter("length(text) > 0").select("doc_id", F.explode(F.expr("sequence(0L, CAST((length(text) + 399) DIV 400 - 1 AS BIGINT))")).alias("idx")).filter("(idx + doc_id) % 4 <> 3")))
query("sentence_chunks")(lambda s, d: D.sentence_chunks(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest")))
query("hash_embedding")(lambda s, d: rounded(D.hash_embeddings(D.sentence_chunks(_docs(s, d)), "chunk").select("doc_id", "idx", F.col("embedding")[0].cast("double").alias("x0"), F.size("embedding").alias("dim"))))

# validation and the simulator
query("walk_forward")(lambda s, d: rounded(validation.walk_forward(B.bars_of(s, d), default_grid(s))))
query("stitched_oos")(lambda s, d: rounded(validation.stitched(validation.walk_forward(B.bars_of(s, d), default_grid(s)))))
query("cpcv_scan")(lambda s, d: rounded(validation.cpcv(B.bars_of(s, d), default_grid(s))))
for name in validation.METHODS:
    query(f"monte_carlo_{name}")(lambda s, d, name=name: rounded(validation.monte_carlo(B.bars_of(s, d), default_grid(s), name)))


def _orders(s, d):
    """A limit order to buy or sell below or above each tenth close, open for three bars."""
    n = B.bars_of(s, d).withColumn("bar", (F.row_number().over(w()) - 1).cast("int"))
    return n.filter("bar % 10 IN (0, 5)").selectExpr("symbol", "bar", "CAST(bar AS BIGINT) AS order_id", "CASE WHEN bar % 10 = 0 THEN 'buy' ELSE 'sell' END AS side", "CASE WHEN bar % 20 < 10 THEN 'market' ELSE 'limit' END AS kind", "2.0D AS shares", "close AS limit_price", "close AS stop_price", "3 AS tif_bars")


query("order_states")(lambda s, d: rounded(simulator.states(B.bars_of(s, d), _orders(s, d), simulator.Rules(stop=0.5, trail=0.6))))
query("order_fills")(lambda s, d: rounded(simulator.fills(B.bars_of(s, d), _orders(s, d), simulator.Rules(stop=0.5, trail=0.6))))
