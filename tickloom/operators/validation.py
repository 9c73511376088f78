"""Search validated out of sample: walk-forward, combinatorial splits, perturbed paths, stitched results.

A job row holds the bars of one symbol and a part of the grid, as in ``kernels.scan``; windows, splits
and paths are further keys, so the work spreads over symbols x parts x those, and in each of them all
sets of all strategies advance together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import metrics as M

#: Ends of training, validation and test as shares of the bars, one row a window.
WINDOWS = [(0.3, 0.4, 0.5), (0.4, 0.5, 0.6), (0.5, 0.6, 0.7), (0.6, 0.7, 0.8), (0.7, 0.8, 0.9), (0.8, 0.9, 1.0)]
OUT = "symbol string, strategy string, part int, combo_id int, train_score double, val_score double, ret double, dd double, trades long"


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _each(work: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` of (symbol, prices, ids by strategy, sets by strategy, part) for each row: tuples after (symbol, strategy, part)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, b, sets, part in zip(*(pdf[c] for c in ("symbol", "b", "sets", "part")), strict=True):
                ids, params = K.grids_of(sets)
                rows = [(symbol, strategy, int(part), *row) for strategy, *row in run(symbol, K.ohlc_of(b), ids, params, int(part))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return work.repartition("symbol", "deal", "part").select("symbol", "b", "sets", "part").mapInPandas(each, schema)


def _all(ohlc: np.ndarray, grids: dict, cost: K.Costs) -> dict:
    return {k: out | {"score": K.score(out["ret"], out["dd"], out["trades"])} for k, out in K.backtest_all(K.bars_from(ohlc), grids, cost).items()}


def _run(strategy: str, ohlc: np.ndarray, sets: list, cost: K.Costs) -> dict:
    return _all(ohlc, {strategy: sets}, cost)[strategy]


def _chosen(train: dict, params: dict) -> tuple[dict, dict]:
    """Of each strategy the place of its best set, the earlier of equals, and that set."""
    places = {k: int(np.argmax(out["score"])) for k, out in train.items()}
    return places, {k: [params[k][at]] for k, at in places.items()}


def gated(train: float, val: float) -> bool:
    """Whether a window's test counts: a good training return with a validation far below it does not."""
    return not (train > 20 and val < -0.5 * train)


def walk_forward(bars: DataFrame, grid: DataFrame, windows: list = WINDOWS, embargo: int = 5, cost: K.Costs = K.Costs()) -> DataFrame:
    """The best set of each training part, on the validation part after an embargo and on the test part.

    A window that the gate rejects has a test result of zero.  Windows with fewer than two bars in a part have no row.
    """

    def run(symbol, ohlc, ids, params, part):
        a, b, c = (int(len(ohlc) * x) for x in windows[part])
        pieces = [ohlc[:a], ohlc[a + embargo : b], ohlc[b:c]]
        if min(map(len, pieces)) < 2:
            return
        train = _all(pieces[0], params, cost)
        places, sets = _chosen(train, params)
        val, test = (_all(x, sets, cost) for x in pieces[1:])
        for k, at in places.items():
            good = gated(train[k]["ret"][at], val[k]["ret"][0])
            yield k, ids[k][at], float(train[k]["score"][at]), float(val[k]["score"][0]), *((float(test[k]["ret"][0]), float(test[k]["dd"][0]), int(test[k]["trades"][0])) if good else (0.0, 0.0, 0))

    return _each(_parts(K.jobs(bars, grid), len(windows)), run, OUT)


def splits(n: int, groups: int = 6, test: int = 2, embargo: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training and test bars of each choice of test groups; other bars within an embargo before or after a test group are in neither."""
    edges = [n * g // groups for g in range(groups + 1)]
    out = []
    for chosen in combinations(range(groups), test):
        held, near = np.zeros(n, bool), np.zeros(n, bool)
        for g in chosen:
            held[edges[g] : edges[g + 1]] = True
            near[max(edges[g] - embargo, 0) : edges[g + 1] + embargo] = True
        out.append((np.flatnonzero(~held & ~near), np.flatnonzero(held)))
    return out


def cpcv(bars: DataFrame, grid: DataFrame, groups: int = 6, test: int = 2, embargo: int = 5, cost: K.Costs = K.Costs()) -> DataFrame:
    """The best set on each split's training bars, on its test bars; ranges are joined end to end."""
    count = len(list(combinations(range(groups), test)))

    def run(symbol, ohlc, ids, params, part):
        inside, outside = splits(len(ohlc), groups, test, embargo)[part]
        if min(len(inside), len(outside)) < 2:
            return
        train = _all(ohlc[inside], params, cost)
        places, sets = _chosen(train, params)
        got = _all(ohlc[outside], sets, cost)
        for k, at in places.items():
            yield k, ids[k][at], float(train[k]["score"][at]), None, float(got[k]["ret"][0]), float(got[k]["dd"][0]), int(got[k]["trades"][0])

    return _each(_parts(K.jobs(bars, grid), count), run, OUT)


def noise(ohlc: np.ndarray, rng: np.random.Generator, scale: float = 0.002) -> np.ndarray:
    """Opens and closes moved by a normal share, wicks by half of one; high and low stay outermost."""
    e = rng.standard_normal((len(ohlc), 4)) * scale
    o, c = ohlc[:, 0] * (1 + e[:, 0]), ohlc[:, 3] * (1 + e[:, 1])
    up = np.maximum(ohlc[:, 1] - ohlc[:, [0, 3]].max(1), 0) * np.maximum(1 + e[:, 2] / 2, 0)
    down = np.maximum(ohlc[:, [0, 3]].min(1) - ohlc[:, 2], 0) * np.maximum(1 + e[:, 3] / 2, 0)
    return np.column_stack([o, np.maximum(o, c) + up, np.minimum(o, c) - down, c])


def shuffled(ohlc: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The four prices of each bar dealt anew: the extremes are high and low, the others open and close."""
    p = rng.permuted(ohlc, axis=1)
    hi = p.argmax(1)
    rows = np.arange(len(p))
    rest = np.where(np.arange(4) == hi[:, None], np.inf, p)
    lo = rest.argmin(1)
    inner = p[(np.arange(4) != hi[:, None]) & (np.arange(4) != lo[:, None])].reshape(-1, 2)
    return np.column_stack([inner[:, 0], p[rows, hi], p[rows, lo], inner[:, 1]])


def bootstrapped(ohlc: np.ndarray, rng: np.random.Generator, block: int = 20) -> np.ndarray:
    """Blocks of bars drawn with replacement, each moved to go on from the close before it."""
    n = len(ohlc)
    before = np.concatenate([ohlc[:1, 0], ohlc[:-1, 3]])
    starts = rng.integers(0, max(n - block, 0) + 1, -(-n // block))
    at = np.minimum((starts[:, None] + np.arange(block)).ravel()[:n], n - 1)
    ratio = ohlc[at] / before[at, None]
    base = before[0] * np.concatenate([[1.0], np.cumprod(ratio[:-1, 3])])
    return ratio * base[:, None]


METHODS = {"noise": noise, "shuffle": shuffled, "bootstrap": bootstrapped}
#: What seeds begin with.
SEEDS = {"noise": 42000, "shuffle": 50000, "bootstrap": 60000}


#: Perturbed paths of each kind.
PATHS = {"noise": 30, "shuffle": 20, "bootstrap": 20}


def monte_carlo(bars: DataFrame, grid: DataFrame, method: str, paths: int | None = None, windows: list = WINDOWS, embargo: int = 5, cost: K.Costs = K.Costs()) -> DataFrame:
    """Every path's result of the set that the last window's training chose, on that window's test bars and all after them, perturbed.

    Seeds depend on path and symbol.  Symbols without a row of that window in ``walk_forward`` have none here.
    """

    def run(symbol, ohlc, ids, params, part):
        if len(ohlc) < 2:
            return
        rng = np.random.default_rng(np.random.SeedSequence([SEEDS[method], part, zlib.crc32(symbol.encode())]))
        for k, got in _all(METHODS[method](ohlc, rng), params, cost).items():
            yield k, ids[k][0], None, None, float(got["ret"][0]), float(got["dd"][0]), int(got["trades"][0])

    best = walk_forward(bars, grid, windows[-1:], embargo, cost).select("symbol", "strategy", "combo_id")
    chosen = best.join(grid, ["strategy", "combo_id"]).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("strategy", "combo_id", "params"))).alias("sets"))
    start = F.floor(F.size("b") * F.lit(float(windows[-1][1]))).cast("int")
    late = K.packed(bars).select("symbol", F.slice("b", start + 1, F.size("b")).alias("b"))
    work = late.join(chosen, "symbol").withColumn("deal", F.lit(0))
    return _each(_parts(work, PATHS[method] if paths is None else paths), run, OUT)


def robustness(bars: DataFrame, grid: DataFrame, bars_per_year: float = 365.0, cost: K.Costs = K.Costs()) -> DataFrame:
    """One row for each symbol and strategy: the stitched test parts, the three kinds of perturbed paths, the deflated Sharpe ratio and the robust score.

    As many trials count as the grid has sets.  A strategy with fewer than three trades or thirty test bars has no score.
    """
    sets = grid.count()
    parts = walk_forward(bars, grid, cost=cost)
    out = stitched(parts)
    for method in METHODS:
        paths = monte_carlo(bars, grid, method, cost=cost).groupBy("symbol", "strategy").agg(F.avg("ret").alias(f"{method}_mean"), F.avg((F.col("ret") > 0).cast("double")).alias(f"{method}_positive"))
        out = out.join(paths, ["symbol", "strategy"], "left")
    n = bars.groupBy("symbol").agg(F.floor(F.count("*") * F.lit(WINDOWS[-1][2] - WINDOWS[0][1])).alias("n_bars"))
    out = out.join(n, "symbol")
    years = F.greatest(F.lit(0.1), F.col("n_bars") / bars_per_year)
    annual = F.col("ret") / years
    sharpe = annual / F.greatest(F.lit(0.01), F.greatest(F.lit(1.0), F.col("dd")) / 2.5 / F.sqrt(years))
    out = out.withColumn("ann_ret", annual).withColumn("sharpe", sharpe)
    out = out.withColumn("dsr", M.deflated_probability(F.col("sharpe"), F.lit(float(sets)), F.col("n_bars").cast("double")))
    able = (F.col("trades") >= 3) & (F.col("n_bars") >= 30)
    score = F.col("sharpe") * F.least(F.lit(1.0), F.sqrt(F.col("trades") / 30)) * (1 + F.greatest(F.lit(0.0), F.col("dsr") - 0.5) * 2)
    return out.withColumn("score", F.when(able, score))


def merged(rows: DataFrame) -> DataFrame:
    """``robustness`` by strategy: means over symbols, trades summed up."""
    means = ["ret", "dd", "sharpe", "dsr", "score", *[f"{m}_{x}" for m in METHODS for x in ("mean", "positive")]]
    return rows.groupBy("strategy").agg(*[F.avg(c).alias(c) for c in means], F.sum("trades").alias("trades"), F.count("*").alias("symbols"))


DECAY = "symbol string, strategy string, part int, combo_id int, month int, ret double"


def decay(bars: DataFrame, grid: DataFrame, train: int = 500, step: int = 63, month: int = 30, months: int = 12, cost: K.Costs = K.Costs()) -> DataFrame:
    """How the best set of each ``train`` bars does in the 1 to ``months`` months after them, from every ``step``-th origin.

    A row is an origin and a number of months, with the return from the origin on; the last months of a symbol may be
    cut by its last bar.  A symbol has an origin while a whole month follows; windows of ten bars or fewer have no row.
    """

    def run(symbol, ohlc, ids, params, part):
        at = train + step * part
        places, sets = _chosen(_all(ohlc[at - train : at], params, cost), params)
        for m in range(1, months + 1):
            ahead = ohlc[at : at + m * month]
            if len(ahead) <= 10:
                break
            got = _all(ahead, sets, cost)
            for k, best in places.items():
                yield k, ids[k][best], m, float(got[k]["ret"][0])

    last = F.floor((F.size("b") - train - month) / F.lit(step)).cast("int")
    work = K.jobs(bars, grid).filter(F.size("b") >= train + month).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return _each(work, run, DECAY)


def decay_table(rows: DataFrame) -> DataFrame:
    """(strategy, month, origins, ret, wins, half_life) of ``decay``: mean return, share of origins that gain, and the first
    later month whose mean is at most half the first month's; null where that never comes or the first month does not gain."""
    by_month = rows.groupBy("strategy", "month").agg(F.count("*").alias("origins"), F.avg("ret").alias("ret"), F.avg((F.col("ret") > 0).cast("double")).alias("wins"))
    first = F.min_by("ret", "month").alias("first")
    half = by_month.join(by_month.groupBy("strategy").agg(first), "strategy").filter("month > 1 AND first > 0 AND ret <= first / 2")
    return by_month.join(half.groupBy("strategy").agg(F.min("month").alias("half_life")), "strategy", "left")


def neighbours(params: list[float], share: float = 0.1) -> list[list[float]]:
    """The sets that differ from one in one parameter by ``share`` up or down; whole numbers stay whole."""
    out = []
    for i, p in enumerate(params):
        for way in (1 + share, 1 - share):
            moved = float(round(p * way)) if float(p).is_integer() else round(p * way, 6)
            if p and moved != p:
                out.append([*params[:i], moved, *params[i + 1 :]])
    return out


def sharpe_of(curve: np.ndarray, per_year: float) -> np.ndarray:
    """Sharpe ratios of equity curves, bars x sets; 0 for a curve that does not move."""
    r = np.diff(curve, axis=0) / np.maximum(curve[:-1], 1e-12)
    sd = r.std(0)
    return np.where(sd > 1e-12, r.mean(0) / np.where(sd > 1e-12, sd, 1) * per_year**0.5, 0.0)


def neighbourhood(bars: DataFrame, chosen: DataFrame, per_year: float = 365.0, drop: float = 0.3, cost: K.Costs = K.Costs()) -> DataFrame:
    """(symbol, strategy, combo_id, sharpe, stability): of the neighbours of each (symbol, strategy, combo_id, params) the share that loses less than ``drop`` of its Sharpe ratio; 0 where that is not above 0."""

    def run(symbol, ohlc, ids, params, part):
        b = K.bars_from(ohlc)
        for strategy, sets in params.items():
            for combo, own in zip(ids[strategy], sets, strict=True):
                near = neighbours(own)
                got = sharpe_of(K.backtest(strategy, b, [own, *near], cost, path=True)["curve"], per_year) if len(ohlc) > 1 else np.zeros(1 + len(near))
                stable = float(((got[0] - got[1:]) / max(abs(got[0]), 1e-12) < drop).sum() / max(len(near), 1)) if got[0] > 0 else 0.0
                yield strategy, combo, float(got[0]), stable

    sets = chosen.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("strategy", "combo_id", "params"))).alias("sets"))
    work = K.packed(bars).join(sets, "symbol").withColumn("deal", F.lit(0)).withColumn("part", F.lit(0))
    return _each(work, run, "symbol string, strategy string, part int, combo_id int, sharpe double, stability double").drop("part")


def gate(rows: DataFrame) -> DataFrame:
    """``rows`` with the gate: six weighted parts from the columns of ``robustness`` and ``neighbourhood``; shares are fractions."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    p = 1 - F.col("dsr")  # the chance that trials alone give as much
    parts = {
        "statistical": 0.6 * unit(F.col("sharpe") / 3) + 0.4 * (1 - p),
        "walkforward": 0.7 * unit(F.coalesce("score", F.lit(0.0)) / 100) + 0.3 * unit(F.col("ret") / 100 / 0.5),
        "neighborhood": F.coalesce("stability", F.lit(0.5)),
        "montecarlo": F.coalesce("noise_positive", F.lit(0.0)),
        "deflated": unit(1 - 2 * p),
        "tail_risk": 0.6 * unit(1 - F.col("dd") / 100 / 0.5) + 0.4,
    }
    return rows.withColumn("gate", F.round(sum(GATE[k] * v for k, v in parts.items()), 4))


def verdict(rows: DataFrame) -> DataFrame:
    """(strategy, checks, verdict): how many of seven marks of robustness a row of ``merged`` bears."""
    marks = ["ret > 0", "dd < 50", "sharpe > 0", "noise_positive > 0.5", "shuffle_positive > 0.3", "bootstrap_positive > 0.3", "dsr > 0.3"]
    checks = sum(F.coalesce(F.expr(m).cast("int"), F.lit(0)) for m in marks)
    return rows.select("strategy", checks.alias("checks")).withColumn("verdict", F.expr("CASE WHEN checks >= 7 THEN 'ROBUST' WHEN checks >= 5 THEN 'STRONG' WHEN checks >= 3 THEN 'MODERATE' ELSE 'WEAK' END"))


#: Weights of the six parts of the gate.
GATE = {"statistical": 0.25, "walkforward": 0.20, "neighborhood": 0.20, "montecarlo": 0.15, "deflated": 0.10, "tail_risk": 0.10}


def stitched(parts: DataFrame) -> DataFrame:
    """(symbol, strategy, ret, dd, trades): the parts compounded in order; a part's own drawdown counts from its start."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "ret", "dd", F.col("trades").cast("long").alias("trades"))))
    zero = F.struct(F.lit(1.0).alias("eq"), F.lit(1.0).alias("pk"), F.lit(0.0).alias("dd"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        eq = F.greatest(F.lit(0.001), s["eq"] * (1 + x["ret"] / 100))
        valley = s["eq"] * (1 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), x["dd"])) / 100)
        pk = F.greatest(s["pk"], eq)
        dd = F.greatest(s["dd"], (s["pk"] - valley) / s["pk"] * 100, (pk - eq) / pk * 100)
        return F.struct(eq.alias("eq"), pk.alias("pk"), dd.alias("dd"), (s["n"] + x["trades"]).alias("n"))

    out = parts.groupBy("symbol", "strategy").agg(F.aggregate(ordered, zero, step).alias("s"))
    return out.select("symbol", "strategy", ((F.col("s.eq") - 1) * 100).alias("ret"), F.least(F.lit(100.0), "s.dd").alias("dd"), F.col("s.n").alias("trades"))
