"""Backtests of grids, fused positions and portfolios, and what is derived from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import kernels as K
from tickloom.operators import validation as V

from .analytics_queries import default_grid
from .bar_queries import rounded
from .oracle import W, bars_cte
from .research_queries import FUSIONS, fused, fusion_ctes

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


_C = K.Costs()
_SELL, _BUY = f"{_C.ss * (1 - _C.cm)!r}e0", f"{_C.sb * (1 + _C.cm)!r}e0"


def _gain(pos: str, ep: str, price: str) -> str:
    long = f"{price} * ({_SELL} / ({ep} * {1 + _C.cm!r}e0))"
    short = f"({ep} * {1 - _C.cm!r}e0 / {_BUY}) / {price}"
    return f"(CASE WHEN {pos} > 0 THEN {long} ELSE {short} END - 1)"


#: A walk over ``ask``: (symbol, k, rn, open, high, low, close, when_short, when_flat, when_long), a row of state for each bar.
WALK = f"""r AS (
  SELECT symbol, k, rn, 0 AS pos, 0e0 AS ep, 1e0 AS eq, 1e0 AS pk, 0e0 AS dd, 0 AS nt, when_flat AS pend, 1e0 AS now, close FROM ask WHERE rn = 1
  UNION ALL
  SELECT symbol, k, rn, pos3, ep2, eq3, greatest(pk, mark), greatest(dd, 1 - mark / greatest(pk, mark)), nt2 + hit::INT,
    CASE WHEN broke THEN 0 WHEN pos3 < 0 THEN when_short WHEN pos3 > 0 THEN when_long ELSE when_flat END, now2, close
  FROM (SELECT *, CASE WHEN broke THEN pk ELSE now2 END AS mark
  FROM (SELECT *, eq3 + CASE WHEN pos3 <> 0 THEN least(eq3, 1e0) * greatest({_gain('pos3', 'ep2', 'close')}, -{_C.sl}e0) ELSE 0 END AS now2
  FROM (SELECT *, CASE WHEN hit THEN greatest(0.01e0, eq2 - least(eq2, 1e0) * {_C.sl + _C.sl_slip}e0) ELSE eq2 END AS eq3, CASE WHEN hit THEN 0 ELSE pos2 END AS pos3
  FROM (SELECT *, pos2 <> 0 AND {_gain('pos2', 'ep2', 'CASE WHEN pos2 > 0 THEN low ELSE high END')} < -{_C.sl}e0 AS hit
  FROM (SELECT *, CASE WHEN closing THEN greatest(0.01e0, eq1 + least(eq1, 1e0) * {_gain('pos', 'ep', 'open')}) WHEN broke THEN 0.01e0 ELSE eq1 END AS eq2,
    CASE WHEN broke OR closing AND opened = 0 THEN 0 WHEN opened <> 0 THEN opened ELSE pos END AS pos2,
    CASE WHEN broke THEN 0 WHEN opened > 0 THEN open * {_C.sb}e0 WHEN opened < 0 THEN open * {_C.ss}e0 ELSE ep END AS ep2, nt + closing::INT AS nt2
  FROM (SELECT *, abs(pend1) >= 2 AND pos <> 0 AS closing, CASE WHEN pend1 IN (1, 3) THEN 1 WHEN pend1 IN (-1, -3) THEN -1 ELSE 0 END AS opened
  FROM (SELECT *, CASE WHEN broke THEN 0 ELSE pend END AS pend1
  FROM (SELECT *, pos <> 0 AND eq1 < 0.01e0 AS broke
  FROM (SELECT a.*, r.pos, r.ep, r.pk, r.dd, r.nt, r.pend, r.eq - CASE WHEN r.pos <> 0 THEN least(r.eq, 1e0) * {_C.dc}e0 ELSE 0 END AS eq1
    FROM r JOIN ask a ON a.symbol = r.symbol AND a.k = r.k AND a.rn = r.rn + 1)))))))))),
f AS (SELECT r.symbol, r.k, (CASE WHEN pos <> 0 THEN greatest(0.01e0, eq + least(eq, 1e0) * {_gain('pos', 'ep', 'close')}) ELSE eq END - 1) * 100 AS ret, dd * 100 AS dd, nt + (pos <> 0)::INT AS trades
  FROM r JOIN (SELECT symbol, max(rn) AS rn FROM n GROUP BY 1) e ON e.symbol = r.symbol AND e.rn = r.rn)"""

#: Moving-average crosses of all sets of the grid, from running sums in order of time.
MA = f"""{bars_cte()}, n AS (SELECT *, row_number() OVER w AS rn FROM bars WINDOW {W}),
  p AS (SELECT symbol, rn, close AS s FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, p.s + n.close FROM p JOIN n ON n.symbol = p.symbol AND n.rn = p.rn + 1),
  q AS (SELECT * FROM p UNION ALL SELECT DISTINCT symbol, 0, 0e0 FROM p),
  g AS (SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS k, a.range AS s, b.range AS l FROM range(5, 100, 5) a, range(10, 201) b WHERE b.range >= a.range + 5 AND (b.range - a.range - 5) % 8 = 0),
  v AS (SELECT d.range AS w, x.symbol, x.rn, (x.s - y.s) / d.range AS m FROM range(1, 201) d JOIN q x ON x.rn >= d.range JOIN q y ON y.symbol = x.symbol AND y.rn = x.rn - d.range),
  u AS (SELECT n.*, g.k, a.m AS x, b.m AS y FROM n CROSS JOIN g LEFT JOIN v a ON a.w = g.s AND a.symbol = n.symbol AND a.rn = n.rn LEFT JOIN v b ON b.w = g.l AND b.symbol = n.symbol AND b.rn = n.rn),
  c AS (SELECT *, coalesce(lag(x) OVER z <= lag(y) OVER z AND x > y, false) AS up, coalesce(lag(x) OVER z >= lag(y) OVER z AND x < y, false) AS down FROM u WINDOW z AS (PARTITION BY symbol, k ORDER BY rn)),
  ask AS MATERIALIZED (SELECT symbol, k, rn, open, high, low, close, CASE WHEN up THEN 3 ELSE 0 END AS when_short, CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END AS when_flat, CASE WHEN down THEN -3 ELSE 0 END AS when_long FROM c)"""


def ma_grid(s):
    return default_grid(s).filter("strategy = 'MA'")


_SCORED = "s AS (SELECT symbol, k::INT AS combo_id, ret, dd, trades, ret / greatest(1, dd) * least(1, trades / 20e0) AS score FROM f)"
query("ma_scan", f"WITH RECURSIVE {MA}, {WALK}, {_SCORED} SELECT symbol, 'MA' AS strategy, combo_id, round(ret, 6) AS ret, round(dd, 6) AS dd, trades, round(score, 6) AS score FROM s")(lambda s, d: rounded(K.scan(B.bars_of(s, d), ma_grid(s))))
query("ma_grid_best", f"WITH RECURSIVE {MA}, {WALK}, {_SCORED} SELECT symbol, 'MA' AS strategy, combo_id, round(ret, 6) AS ret, round(dd, 6) AS dd, trades, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, combo_id) = 1")(
    lambda s, d: rounded(K.best(K.scan(B.bars_of(s, d), ma_grid(s)))))

_CURVE = "e AS (SELECT r.symbol, r.rn - 1 AS bar, CASE WHEN r.rn = m.rn THEN f.ret / 100 + 1 ELSE now END AS equity, m.rn AS bars FROM r JOIN f ON f.symbol = r.symbol AND f.k = r.k JOIN (SELECT symbol, max(rn) AS rn FROM n GROUP BY 1) m ON m.symbol = r.symbol WHERE r.k = 0)"
query("portfolio_backtest", f"""WITH RECURSIVE {MA.replace("CROSS JOIN g LEFT", "CROSS JOIN (SELECT * FROM g WHERE k = 0) g LEFT")}, {WALK}, {_CURVE},
  t AS (SELECT bar, sum(equity / (SELECT count(DISTINCT symbol) FROM n)) AS equity FROM e WHERE bar < (SELECT min(bars) FROM e) GROUP BY bar),
  x AS (SELECT *, equity / greatest(lag(equity) OVER (ORDER BY bar), 1e-10) - 1 AS r, max(equity) OVER (ORDER BY bar ROWS UNBOUNDED PRECEDING) AS pk FROM t)
  SELECT round((arg_max(equity, bar) / arg_min(equity, bar) - 1) * 100, 6) AS ret, round(max(1 - equity / pk) * 100, 6) AS dd, round(avg(r) / stddev_pop(r) * sqrt(365), 6) AS sharpe, count(*) AS bars FROM x""")(
    lambda s, d: rounded(K.portfolio(K.curves(B.bars_of(s, d), ma_grid(s).filter("combo_id = 0")))))


@query("multi_tf_backtest", f"""WITH RECURSIVE {fusion_ctes()}, n AS (SELECT *, row_number() OVER w AS rn FROM b1 WINDOW {W}),
  want AS ({" UNION ALL ".join(f"SELECT symbol, ts, '{name}' AS k, CAST({expr} AS INT) AS want FROM g" for name, expr in FUSIONS)}),
  ask AS MATERIALIZED (SELECT n.symbol, k, rn, open, high, low, close, CASE WHEN want > 0 THEN 3 WHEN want = 0 THEN 2 ELSE 0 END AS when_short, want AS when_flat, CASE WHEN want < 0 THEN -3 WHEN want = 0 THEN 2 ELSE 0 END AS when_long FROM n JOIN want ON want.symbol = n.symbol AND want.ts = n.ts),
  {WALK} SELECT symbol, k AS name, round(ret, 6) AS ret, round(dd, 6) AS dd, trades FROM f""")
def multi_tf_backtest(s, d):
    """Positions by interval, fused in three ways, followed on the finest bars."""
    want = fused(s, d).selectExpr("symbol", "ts", *[f"CAST({expr} AS INT) AS {name}" for name, expr in FUSIONS])
    return rounded(K.followed(B.bars_of(s, d, "1 hour").join(want, ["symbol", "ts"]), [name for name, _ in FUSIONS]))


def _chosen(s, d):
    grid = default_grid(s)
    return K.best(K.scan(B.bars_of(s, d), grid)).join(grid, ["strategy", "combo_id"]).select("symbol", "strategy", "combo_id", "params")


query("neighbourhood_stability")(lambda s, d: rounded(V.neighbourhood(B.bars_of(s, d), _chosen(s, d))))
query("robustness")(lambda s, d: rounded(V.robustness(B.bars_of(s, d), default_grid(s))))
query("robust_by_strategy")(lambda s, d: rounded(V.merged(V.robustness(B.bars_of(s, d), default_grid(s)))))
query("robust_verdict")(lambda s, d: V.verdict(V.merged(V.robustness(B.bars_of(s, d), default_grid(s)))))
query("validated_gate")(lambda s, d: rounded(V.gate(V.robustness(B.bars_of(s, d), default_grid(s)).join(V.neighbourhood(B.bars_of(s, d), _chosen(s, d)).select("symbol", "strategy", "stability"), ["symbol", "strategy"], "left")).select("symbol", "strategy", "gate")))
query("best_strategy")(lambda s, d: rounded(K.best(K.scan(B.bars_of(s, d), default_grid(s))).groupBy("symbol").agg(F.max_by(F.struct("strategy", "combo_id", "ret", "score"), F.struct("score", "strategy")).alias("x")).select("symbol", "x.*")))
query("cpcv_summary")(lambda s, d: rounded(V.cpcv(B.bars_of(s, d), default_grid(s)).groupBy("symbol", "strategy").agg(F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("sd_ret"), F.avg("dd").alias("mean_dd"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.sum("trades").alias("trades"), F.count("*").alias("splits"))))
query("params_by_window")(lambda s, d: rounded(V.walk_forward(B.bars_of(s, d), default_grid(s)).groupBy("strategy").pivot("part", list(range(len(V.WINDOWS)))).agg(F.avg("ret"))))


def _decay(s, d):
    return V.decay(B.daily_bars(s, d), default_grid(s).filter("strategy IN ('MA', 'MACD', 'MomBreak')"))


query("param_decay")(lambda s, d: rounded(_decay(s, d)))
query("param_decay_table")(lambda s, d: rounded(V.decay_table(_decay(s, d))))
