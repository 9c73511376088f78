"""Strategy backtests, advanced bar by bar for all parameter sets of all strategies at once.

A strategy is compiled to a table: for each bar and set the order that its close
asks for when flat, long or short.  One loop over the bars then moves a vector of
all sets, whatever their strategies, so a bar costs a few array operations however
many sets there are.  What hangs on the state of a position (stops behind a price,
days held, the mode of entry) is added in the loop for the sets that need it.

Order of events in a bar: costs and the pending order at the open, intra-bar stop,
decision at the close (filled at the next open), mark to market, drawdown.
Positions still open close at the last close.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import series as S

#: Share of equity deployed by leverage: fixed values of the cost model.
DEPLOYED = {1: 1.0, 2: 0.9, 4: 0.7, 5: 0.6, 10: 0.4, 20: 0.25, 50: 0.15}


@dataclass(frozen=True)
class Costs:
    """Kernel costs: price factors of buys and sells, commission, leverage, holding costs by bar, stop."""

    sb: float = 1.0003
    ss: float = 0.9997
    cm: float = 0.0004
    lev: float = 1.0
    dc: float = 0.0003
    dc_short: float = 0.0
    sl: float = 0.80
    pfrac: float = 1.0
    sl_slip: float = 0.005

    @classmethod
    def of(cls, bps: float, commission: float, leverage: float = 1.0, funding: float = 0.0, bars_per_day: float = 1.0, borrow: float = 0.0, bars_per_year: float = 365.0, stop: float = 0.80) -> Costs:
        slip = bps / 1e4 * leverage**0.5
        dc = funding / bars_per_day * (leverage * (1 + 0.02 * leverage) if leverage > 1 else 1.0)
        return cls(1 + slip, 1 - slip, commission, leverage, dc, borrow / bars_per_year, stop, DEPLOYED.get(int(leverage), max(0.1, leverage**-0.5)))


def smoothed(x: np.ndarray, alpha, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """y = y + alpha (x - y) down each column of ``x``, from ``first`` at row ``begin`` on; NaN before.

    ``alpha`` is a vector (by column) or has the shape of ``x``.
    """
    out = np.full(x.shape, np.nan)
    n, k = x.shape
    rates = np.broadcast_to(alpha, (n, k))
    y = np.zeros(k)
    for i in range(int(begin.min()) if k else n, n):
        y = np.where(begin == i, first, y + rates[i] * (x[i] - y))
        out[i] = y
    out[np.arange(n)[:, None] < begin[None, :]] = np.nan
    return out


class Bars:
    """Price vectors of one symbol with each indicator computed once for all parameter sets."""

    def __init__(self, c, o, h, l) -> None:
        self.c, self.o, self.h, self.l = (np.asarray(x, float) for x in (c, o, h, l))
        self.n = len(self.c)
        self.ret = np.nan_to_num(self.c / S.shifted(self.c, 1) - 1) if self.n else self.c
        self._memo: dict = {}

    def table(self, name: str, *params: np.ndarray, lag: int = 0) -> np.ndarray:
        """bars x parameter sets of an indicator, ``lag`` bars ago; equal parameters are computed once."""
        wanted, place = np.unique(np.column_stack(params), axis=0, return_inverse=True)
        key = (name, wanted.tobytes())
        if key not in self._memo:
            with np.errstate(divide="ignore", invalid="ignore"):
                self._memo[key] = np.asarray(getattr(self, "_" + name)(*(wanted.T if name in ("mama", "fama") else wanted.T.astype(int))))
        out = self._memo[key][:, place.ravel()]
        if lag:
            out = np.concatenate([np.full((min(lag, self.n), out.shape[1]), np.nan), out[: max(self.n - lag, 0)]])
        return out

    def _each(self, fn, *params) -> np.ndarray:
        return np.stack([fn(*p) for p in zip(*params, strict=True)], 1)

    def _ma(self, n):
        """Means as differences of running sums, one addition a bar in order of time."""
        sums = np.concatenate([[0.0], np.cumsum(self.c)])
        return self._each(lambda w: np.concatenate([np.full(min(w - 1, self.n), np.nan), (sums[w:] - sums[:-w]) / w]), n)

    def _sd(self, n):
        return self._each(lambda w: S.std(self.c, w), n)

    def _hh(self, n):
        return self._each(lambda w: S.highest(self.h, w), n)

    def _ll(self, n):
        return self._each(lambda w: S.lowest(self.l, w), n)

    def _mom(self, n):
        return self._each(lambda w: self.c / S.shifted(self.c, w) - 1, n)

    def _vol(self, n):
        return self._each(lambda w: np.sqrt(np.maximum(1e-20, S.std(self.ret, w) ** 2)), n)

    def _rms(self, n):
        return self._each(lambda w: np.sqrt(S.mean(self.ret * self.ret, w)), n)

    def _up(self, n):
        rose = (np.diff(self.c, prepend=self.c[:1]) > 0).astype(float)
        return self._each(lambda w: S.mean(rose, w), n)

    def _ema(self, n):
        x = np.broadcast_to(self.c[:, None], (self.n, len(n)))
        return smoothed(x, 2 / (n + 1), x[0] if self.n else np.zeros(len(n)), np.zeros(len(n), int))

    def _line(self, fast, slow):
        return self.table("ema", fast) - self.table("ema", slow)

    def _signal(self, fast, slow, span):
        x = self.table("line", fast, slow)
        return smoothed(x, 2 / (span + 1), x[0] if self.n else np.zeros(len(span)), np.zeros(len(span), int))

    def _wilder(self, x, n, begin):
        first = np.array([np.mean(x[b + 1 - w : b + 1]) if self.n > b else np.nan for w, b in zip(n, begin, strict=True)])
        return smoothed(np.broadcast_to(x[:, None], (self.n, len(n))), 1 / n, first, begin)

    def _atr(self, n):
        return self._wilder(S.true_range(self.h, self.l, self.c), n, n - 1)

    def _rsi(self, n):
        step = np.diff(self.c, prepend=self.c[:1])
        gain, loss = self._wilder(np.maximum(step, 0), n, n), self._wilder(np.maximum(-step, 0), n, n)
        return np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))

    def _kama(self, n, fast, slow):
        c = self.c
        ratio = {}
        for w in np.unique(n).tolist():
            path = np.concatenate([[np.nan], S.rolling(np.abs(np.diff(c)), w, np.sum)])[: self.n] if self.n else c
            ratio[w] = np.where(path > 0, np.abs(c - S.shifted(c, w)) / path, 0.0)
        a, b = 2 / (fast + 1), 2 / (slow + 1)
        rate = (np.stack([ratio[w] for w in n.tolist()], 1) * (a - b) + b) ** 2
        first = np.array([c[w - 1] if self.n >= w else np.nan for w in n.tolist()])
        return smoothed(np.broadcast_to(c[:, None], rate.shape), rate, first, n - 1)

    def _mesa(self, fast, slow):
        key = ("mesa", fast.tobytes(), slow.tobytes())
        if key not in self._memo:
            self._memo[key] = S.mama_many(self.c, fast, slow)
        return self._memo[key]

    def _mama(self, fast, slow):
        return self._mesa(fast, slow)[0]

    def _fama(self, fast, slow):
        return self._mesa(fast, slow)[1]


@dataclass
class Plan:
    """What a strategy's sets ask for at each close (bars x sets), first bar and whether they run at all."""

    long_in: np.ndarray
    short_in: np.ndarray
    long_out: np.ndarray
    short_out: np.ndarray
    start: np.ndarray
    runs: np.ndarray | None = None
    #: Entries turn an open position round; otherwise it is left first.
    flip: bool = False
    #: Bars that count for drawdown, where not all do.
    marked: np.ndarray | None = None
    #: Stops this far behind the entry price, or behind the best close since entry.
    behind_entry: np.ndarray | None = None
    behind_best: np.ndarray | None = None
    #: Closes a position is held for.
    hold: np.ndarray | None = None
    #: Which of two modes a bar is in; a position is left where its mode of entry ends.
    mode: np.ndarray | None = None

    def orders(self) -> np.ndarray:
        """3 x bars x sets: orders when short, flat and long.  1, -1 enter; 2 leaves; 3, -3 turn round."""
        out = np.zeros((3, *self.long_in.shape), np.int8)
        out[1] = np.where(self.long_in, 1, np.where(self.short_in, -1, 0))
        if self.flip:
            out[0] = np.where(self.long_in, 3, np.where(self.short_out, 2, 0))
            out[2] = np.where(self.short_in, -3, np.where(self.long_out, 2, 0))
        else:
            out[0], out[2] = np.where(self.short_out, 2, 0), np.where(self.long_out, 2, 0)
        return out


def _never(b: Bars, k: int) -> np.ndarray:
    return np.zeros((b.n, k), bool)


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full((min(1, len(x)), x.shape[1]), np.nan), x[:-1]])


def _crosses(b: Bars, x: np.ndarray, y: np.ndarray, start: int = 1, runs=None) -> Plan:
    """Always in: long on a cross above, short on a cross below."""
    x0, y0, no = _before(x), _before(y), _never(b, x.shape[1])
    return Plan((x0 <= y0) & (x > y), (x0 >= y0) & (x < y), no, no, np.full(x.shape[1], start), runs, flip=True)


def _score_plan(z: np.ndarray, above, below, leave_long, leave_short, start) -> Plan:
    """Enters where a score passes a threshold, leaves where it falls back."""
    return Plan(z > above, z < below, z < leave_long, z > leave_short, start.astype(int))


def _rsi_plan(b: Bars, n, low, high) -> Plan:
    r = b.table("rsi", n)
    under, over = r < low, r > high
    return Plan(under, over & ~under, ~under & ~over & (r > 50), ~under & ~over & (r < 50), np.ones(len(n), int), flip=True)


def _drift_plan(b: Bars, n, share, hold) -> Plan:
    u = b.table("up", n)
    fall = u >= share
    return Plan((u <= 1 - share) & ~fall, fall, _never(b, len(n)), _never(b, len(n)), n.astype(int), hold=hold)


def _multifactor_plan(b: Bars, r, m, v, above, below) -> Plan:
    calm = np.maximum(0, 1 - 20 * b.table("rms", v))
    z = ((100 - b.table("rsi", r)) / 100 + np.clip(b.table("mom", m), -0.5, 0.5) + 0.5 + calm) / 3
    return _score_plan(z, above, below, 0.5, 0.5, np.maximum(np.maximum(r + 1, m), v))


def _bollinger_plan(b: Bars, n, k) -> Plan:
    c, m, s = b.c[:, None], b.table("ma", n), b.table("sd", n)
    able = s >= 1e-10
    return Plan(able & (c < m - k * s), able & (c > m + k * s), able & (c >= m), able & (c <= m), n.astype(int))


def _keltner_plan(b: Bars, e, a, k) -> Plan:
    c, m, w = b.c[:, None], b.table("ema", e), k * b.table("atr", a)
    able = ~np.isnan(w)
    return Plan(able & (c > m + w), able & (c < m - w), able & (c < m), able & (c > m), np.maximum(e, a).astype(int))


def _zscore_plan(b: Bars, n, enter, leave, give_up) -> Plan:
    sd = b.table("sd", n)
    z = np.where(sd > 0, (b.c[:, None] - b.table("ma", n)) / np.where(sd > 0, sd, 1), np.nan)
    return Plan(z < -enter, z > enter, (z > -leave) | (z > give_up), (z < leave) | (z < -give_up), n.astype(int), b.n >= n + 2)


def _turtle_plan(b: Bars, e, x, a, k) -> Plan:
    c, t = b.c[:, None], b.table
    start = np.maximum(np.maximum(e, x), a).astype(int)
    return Plan(c > t("hh", e, lag=1), c < t("ll", e, lag=1), c < t("ll", x, lag=1), c > t("hh", x, lag=1), start, behind_entry=k * t("atr", a))


def _kama_plan(b: Bars, n, fast, slow, k, a) -> Plan:
    c, now = b.c[:, None], b.table("kama", n, fast, slow)
    before = _before(now)
    return Plan((c > now) & (now > before), (c < now) & (now < before), now < before, now > before, np.maximum(n + 2, a).astype(int), b.n >= n + 2, behind_entry=k * b.table("atr", a))


def _donchian_plan(b: Bars, e, a, k) -> Plan:
    c, no = b.c[:, None], _never(b, len(e))
    up = c > b.table("hh", e, lag=1)
    return Plan(up, (c < b.table("ll", e, lag=1)) & ~up, no, no, np.maximum(e, a).astype(int), b.n >= e + a, behind_best=k * b.table("atr", a))


def _mombreak_plan(b: Bars, n, near, a, k) -> Plan:
    c, no = b.c[:, None], _never(b, len(n))
    up = c >= b.table("hh", n) * (1 - near)
    return Plan(up, (c <= b.table("ll", n) * (1 + near)) & ~up, no, no, np.maximum(n, a).astype(int), b.n >= np.maximum(n, a) + 2, behind_best=k * b.table("atr", a))


def _volregime_plan(b: Bars, a, limit, ms, ml, low, high) -> Plan:
    hot = b.table("atr", a) / b.c[:, None] > limit
    r, s, g = b.table("rsi", np.full(len(a), 14)), b.table("ma", ms), b.table("ma", ml)
    s0, g0 = _before(s), _before(g)
    long_in, short_in = np.where(hot, r < low, (s0 <= g0) & (s > g)), np.where(hot, r > high, (s0 >= g0) & (s < g))
    return Plan(long_in, short_in & ~long_in, np.where(hot, r > 50, s < g), np.where(hot, r < 50, s > g), np.maximum(np.maximum(a, 15), ml).astype(int), ms < ml, mode=hot)


def _regime_ema_plan(b: Bars, a, limit, f, s, t) -> Plan:
    start = np.maximum(np.maximum(a, s), t).astype(int)
    hot = b.table("atr", a) / b.c[:, None] > limit
    x, y, trend = b.table("ema", f), b.table("ema", s), b.table("ema", t)
    x0, y0, off = _before(x), _before(y), (b.c[:, None] - trend) / trend
    return Plan(np.where(hot, (x > y) & (x0 <= y0), off < -0.02), np.where(hot, (x < y) & (x0 >= y0), off > 0.02), np.where(hot, x < y, off > 0), np.where(hot, x > y, off < 0), start, (f < s) & (b.n >= start + 2))


def _dualmom_plan(b: Bars, f, s) -> Plan:
    x, y = b.table("mom", f), b.table("mom", s)
    longest = np.maximum(f, s)
    return Plan((x > 0) & (y > 0), (x < 0) & (y < 0), (x < 0) | (y < 0), (x > 0) | (y > 0), longest.astype(int), (f < s) & (b.n >= longest + 2))


def _consensus_plan(b: Bars, ms, ml, r, m, low, high, least) -> Plan:
    s, g, x, mom = b.table("ma", ms), b.table("ma", ml), b.table("rsi", r), b.table("mom", m)
    seen = ~(np.isnan(s) | np.isnan(g) | np.isnan(x))
    v = np.sign(s - g) + np.select([x < low, x > high], [1, -1], 0) + np.select([mom > 0.02, mom < -0.02], [1, -1], 0)
    return Plan(seen & (v >= least), seen & (v <= -least), seen & (v <= -1), seen & (v >= 1), m.astype(int), (ms < ml) & (b.n >= m + 2), marked=seen)


RULES = {
    "MA": lambda b, s, g: _crosses(b, b.table("ma", s), b.table("ma", g)),
    "RSI": _rsi_plan,
    "MACD": lambda b, f, s, g: _crosses(b, b.table("line", f, s), b.table("signal", f, s, g)),
    "Drift": _drift_plan,
    "RAMOM": lambda b, m, v, enter, leave: _score_plan(b.table("mom", m) / b.table("vol", v), enter, -enter, leave, -leave, np.maximum(m, v)),
    "Turtle": _turtle_plan,
    "Bollinger": _bollinger_plan,
    "Keltner": _keltner_plan,
    "MultiFactor": _multifactor_plan,
    "VolRegime": _volregime_plan,
    "MESA": lambda b, f, s: _crosses(b, b.table("mama", f, s), b.table("fama", f, s), 7, np.full(len(f), b.n >= 40)),
    "KAMA": _kama_plan,
    "Donchian": _donchian_plan,
    "ZScore": _zscore_plan,
    "MomBreak": _mombreak_plan,
    "RegimeEMA": _regime_ema_plan,
    "DualMom": _dualmom_plan,
    "Consensus": _consensus_plan,
}
#: A first parameter set of each strategy.
FIRST = {"MA": (5, 10), "RSI": (5, 15, 60), "MACD": (4, 9, 3), "Drift": (10, 0.55, 3), "RAMOM": (5, 5, 1.0, 0.0), "Turtle": (10, 5, 10, 1.5), "Bollinger": (10, 1.0), "Keltner": (10, 10, 1.0), "MultiFactor": (7, 10, 10, 0.55, 0.25), "VolRegime": (14, 0.015, 5, 30, 25, 70), "MESA": (0.3, 0.02), "KAMA": (10, 2, 20, 1.5, 14), "Donchian": (10, 10, 1.5), "ZScore": (15, 1.5, 0.0, 3.0), "MomBreak": (20, 0.0, 10, 1.5), "RegimeEMA": (14, 0.015, 5, 20, 50), "DualMom": (5, 20), "Consensus": (10, 50, 14, 20, 25, 70, 2)}

#: The search ranges of each strategy, 4,839 sets; a set's place in its list is its combo_id.
GRIDS = {
    "MA": [(s, g) for s in range(5, 100, 5) for g in range(s + 5, 201, 8)],
    "RSI": list(product(range(5, 101, 7), range(15, 40, 5), range(60, 90, 5))),
    "MACD": [(f, s, g) for f in range(4, 50, 5) for s in range(f + 5, 120, 8) for g in range(3, min(s, 50), 6)],
    "Drift": list(product(range(10, 120, 10), (0.55, 0.60, 0.65, 0.70), range(3, 25, 4))),
    "RAMOM": list(product(range(5, 100, 15), range(5, 50, 10), (1.0, 2.0, 3.0), (0.0, 0.5, 1.0))),
    "Turtle": list(product(range(10, 80, 10), range(5, 40, 7), (10, 14, 20), (1.5, 2.0, 2.5, 3.0))),
    "Bollinger": list(product(range(10, 120, 5), (1.0, 1.5, 2.0, 2.5, 3.0))),
    "Keltner": list(product(range(10, 100, 10), (10, 14, 20), (1.0, 1.5, 2.0, 2.5, 3.0))),
    "MultiFactor": list(product((7, 14, 21), range(10, 60, 10), range(10, 40, 10), (0.55, 0.60, 0.65, 0.70), (0.25, 0.30, 0.35, 0.40))),
    "VolRegime": [x for x in product((14, 20), (0.015, 0.020, 0.025, 0.030), (5, 10, 20), (30, 50, 80), (25, 30), (70, 75)) if x[2] < x[3]],
    "MESA": list(product((0.3, 0.5, 0.7), (0.02, 0.05, 0.10))),
    "KAMA": list(product((10, 15, 20), (2, 3), (20, 30, 50), (1.5, 2.0, 2.5, 3.0), (14, 20))),
    "Donchian": list(product(range(10, 80, 10), (10, 14, 20), (1.5, 2.0, 2.5, 3.0))),
    "ZScore": list(product(range(15, 100, 10), (1.5, 2.0, 2.5), (0.0, 0.5), (3.0, 4.0))),
    "MomBreak": list(product((20, 40, 60, 100, 200), (0.00, 0.02, 0.05, 0.08), (10, 14, 20), (1.5, 2.0, 2.5, 3.0))),
    "RegimeEMA": [x for x in product((14, 20), (0.015, 0.020, 0.025), (5, 10, 15), (20, 40, 60), (50, 80, 100)) if x[2] < x[3]],
    "DualMom": [x for x in product((5, 10, 20, 40, 60), (20, 40, 80, 120, 200)) if x[0] < x[1]],
    "Consensus": [x for x in product((10, 20), (50, 100, 150), (14, 21), (20, 40), (25, 30), (70, 75), (2, 3)) if x[0] < x[1]],
}


def compiled(strategy: str, bars: Bars, params) -> Plan:
    if strategy not in RULES:
        raise KeyError(f"unknown strategy {strategy!r}")
    sets = np.atleast_2d(np.asarray(params, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return RULES[strategy](bars, *sets.T)


class _Sets:
    """The plans of several strategies side by side: orders of all sets, and the columns that need more."""

    def __init__(self, n: int, plans: list[Plan]) -> None:
        at = np.concatenate([[0], np.cumsum([p.long_in.shape[1] for p in plans])])
        self.k = int(at[-1])
        self.orders = np.concatenate([p.orders() for p in plans], 2)
        # a set that never runs starts after the last bar
        self.start = np.concatenate([np.where(True if p.runs is None else p.runs, p.start, n) for p in plans])
        self.cols = {name: np.concatenate([np.arange(a, b) for p, a, b in zip(plans, at[:-1], at[1:], strict=True) if getattr(p, name) is not None] or [np.zeros(0, int)]) for name in ("marked", "behind_entry", "behind_best", "hold", "mode")}
        self.more = {name: np.concatenate([getattr(p, name) for p in plans if getattr(p, name) is not None], -1) for name, cols in self.cols.items() if len(cols)}


def _run(bars: Bars, sets: _Sets, cost: Costs, path: bool) -> dict:
    k, n, cols, more = sets.k, bars.n, sets.cols, sets.more
    pos, ep = np.zeros(k, np.int8), np.zeros(k)
    # what a unit of price is worth to a long, and its inverse to a short; zero where there is none
    to_long, to_short, inside = np.zeros(k), np.zeros(k), np.zeros(k)
    equity, peak, worst, trades, pend = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int8)
    curve, held = (np.ones((n, k)), np.zeros((n, k), np.int8)) if path else (None, None)
    sell, buy = cost.ss * (1 - cost.cm), cost.sb * (1 + cost.cm)
    entry, best, hold, mode, marked = (cols[x] for x in ("behind_entry", "behind_best", "hold", "mode", "marked"))
    long_line, short_line = np.zeros(len(best)), np.full(len(best), 1e18)
    days, entered = np.zeros(len(hold)), np.zeros(len(mode), bool)
    holding = np.array([cost.dc + cost.dc_short, 0.0, cost.dc])
    latest = int(sets.start.max()) if k else 0

    def deployed(equity):
        return np.minimum(equity, 1.0) * cost.pfrac

    def flat(which):
        pos[which] = 0
        to_long[which] = to_short[which] = inside[which] = 0.0

    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(int(sets.start.min()) if k else n, n):
            o, h, l, c = bars.o[i], bars.h[i], bars.l[i], bars.c[i]
            broke = None
            equity -= deployed(equity) * holding[pos + 1]
            if equity.min() < 0.01 and (low := np.flatnonzero((equity < 0.01) & (pos != 0))).size:
                broke = low
                equity[broke] = 0.01
                ep[broke] = 0.0
                pend[broke] = 0
                flat(broke)
            due = np.flatnonzero(pend)
            if due.size:
                p = pend[due]
                out = due[(np.abs(p) >= 2) & (pos[due] != 0)]
                equity[out] = np.maximum(0.01, equity[out] + deployed(equity[out]) * (o * to_long[out] + to_short[out] / o - 1) * cost.lev)
                trades[out] += 1
                flat(out)
                up, down = due[(p == 1) | (p == 3)], due[(p == -1) | (p == -3)]
                pos[up], ep[up], inside[up] = 1, o * cost.sb, 1.0
                pos[down], ep[down], inside[down] = -1, o * cost.ss, 1.0
                to_long[up], to_short[up] = sell / (o * cost.sb * (1 + cost.cm)), 0.0
                to_long[down], to_short[down] = 0.0, o * cost.ss * (1 - cost.cm) / buy
                if best.size:
                    asked, width = pend[best], more["behind_best"][i]
                    able = ~np.isnan(width)
                    long_line = np.where(able & (asked == 1), o - width, long_line)
                    short_line = np.where(able & (asked == -1), o + width, short_line)
            hit = (l * to_long + to_short / h - inside) * cost.lev < -cost.sl
            if hit.any():
                hit = np.flatnonzero(hit)
                equity[hit] = np.maximum(0.01, equity[hit] - deployed(equity[hit]) * (cost.sl + cost.sl_slip))
                trades[hit] += 1
                flat(hit)
            else:
                hit = None
            pend = np.choose(pos + 1, sets.orders[:, i])
            if entry.size:
                own, width = pos[entry], more["behind_entry"][i]
                away = np.where(own > 0, c < ep[entry] / cost.sb - width, (own < 0) & (c > ep[entry] / cost.ss + width))
                pend[entry[away]] = 2
            if best.size:
                own, width = pos[best], more["behind_best"][i]
                long_line = np.where((own > 0) & (c - width > long_line), c - width, long_line)
                short_line = np.where((own < 0) & (c + width < short_line), c + width, short_line)
                pend[best[np.where(own > 0, c < long_line, (own < 0) & (c > short_line))]] = 2
            if hold.size:
                for gone in (broke, hit):
                    if gone is not None:
                        days[np.isin(hold, gone)] = 0
                own, asked = pos[hold] != 0, pend[hold]
                days = np.where(own, days + 1, days)
                over = own & (days >= more["hold"])
                pend[hold[over]] = 2
                days = np.where(over | ~own & (asked != 0), 0, days)
            if mode.size:
                own, hot = pos[mode], more["mode"][i]
                pend[mode[(own != 0) & (hot != entered)]] = 2
                entered = np.where((own == 0) & (pend[mode] != 0), hot, entered)
            if i < latest:
                pend[sets.start > i] = 0
            if broke is not None:
                pend[broke] = 0
            now = equity + deployed(equity) * np.maximum((c * to_long + to_short / c - inside) * cost.lev, -cost.sl)
            if path:
                curve[i], held[i] = now, pos
            if marked.size:
                now[marked] = np.where(more["marked"][i], now[marked], peak[marked])
            if broke is not None:
                now[broke] = peak[broke]
            np.maximum(peak, now, out=peak)
            np.maximum(worst, 1 - now / peak, out=worst)
        still = pos != 0
        if n:
            equity = np.where(still, np.maximum(0.01, equity + deployed(equity) * (bars.c[-1] * to_long + to_short / bars.c[-1] - 1) * cost.lev), equity)
        if path and n:
            curve[-1] = equity
    return {"ret": (equity - 1) * 100, "dd": worst * 100, "trades": trades + still, "curve": curve, "held": held}


#: Bars times sets whose orders are held at once.
HELD = 1 << 25


def backtest_all(bars: Bars, grids: dict[str, list], cost: Costs = Costs(), path: bool = False) -> dict[str, dict]:
    """For each strategy the return %, drawdown %, closed trades of each of its sets; with ``path`` also equity and positions by bar."""
    most = max(1, HELD // max(bars.n, 1))
    jobs = [(name, sets[i : i + most]) for name, sets in grids.items() for i in range(0, len(sets), most)]
    found: dict[str, list[dict]] = {name: [] for name in grids}
    while jobs:
        some, size = [], 0
        while jobs and (not some or size + len(jobs[0][1]) <= most):
            some.append(jobs.pop(0))
            size += len(some[-1][1])
        out = _run(bars, _Sets(bars.n, [compiled(name, bars, sets) for name, sets in some]), cost, path)
        at = 0
        for name, sets in some:
            own = slice(at, at + len(sets))
            found[name].append({x: None if v is None else v[..., own] for x, v in out.items()})
            at += len(sets)
    return {name: {x: None if parts[0][x] is None else np.concatenate([p[x] for p in parts], -1) for x in parts[0]} for name, parts in found.items() if parts}


def backtest(strategy: str, bars: Bars, params, cost: Costs = Costs(), path: bool = False) -> dict:
    """``backtest_all`` of one strategy."""
    return backtest_all(bars, {strategy: np.atleast_2d(np.asarray(params, float))}, cost, path)[strategy]


def follow(positions: np.ndarray, bars: Bars, cost: Costs = Costs()) -> dict:
    """Backtest of given positions, bars x sets: the one decided at a close is taken at the next open."""
    want = np.asarray(positions).reshape(bars.n, -1)
    up, down, none = want > 0, want < 0, want == 0
    plan = Plan(up, down, none, none, np.zeros(want.shape[1], int), flip=True)
    return _run(bars, _Sets(bars.n, [plan]), cost, True)


def score(ret, dd, trades):
    return ret / np.maximum(1.0, dd) * np.minimum(1.0, trades / 20)


#: Sets of a grid that one task advances, about; a larger grid is dealt to several.
PER_TASK = 1 << 15


def packed(bars: DataFrame) -> DataFrame:
    """(symbol, b): the bars of a symbol in order.  A backtest is one walk over them, so they are one row."""
    return bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close"))).alias("b"))


def dealt(grid: DataFrame) -> tuple[DataFrame, int]:
    """(deal, sets) rows of a grid, (strategy, combo_id, params array<double>), with all sets of a strategy in one, and how many."""
    deals = max(1, -(-grid.count() // PER_TASK))
    number = F.pmod(F.xxhash64("strategy"), F.lit(deals)).cast("int") if deals > 1 else F.lit(0)
    return grid.groupBy(number.alias("deal")).agg(F.array_sort(F.collect_list(F.struct("strategy", "combo_id", "params"))).alias("sets")), deals


def jobs(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """(symbol, b, deal, sets): the bars of each symbol with each part of the grid, by an equal join on the part."""
    sets, deals = dealt(grid)
    return packed(bars).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).join(sets, "deal")


def grids_of(sets) -> tuple[dict[str, list], dict[str, list]]:
    """By strategy: combo ids and parameter sets of a row of ``dealt``."""
    ids: dict[str, list] = {}
    params: dict[str, list] = {}
    for r in sets:
        ids.setdefault(r["strategy"], []).append(r["combo_id"])
        params.setdefault(r["strategy"], []).append(list(r["params"]))
    return ids, params


def ohlc_of(b) -> np.ndarray:
    return np.array([[r[k] for k in ("open", "high", "low", "close")] for r in b], float).reshape(-1, 4)


def bars_from(ohlc: np.ndarray) -> Bars:
    return Bars(ohlc[:, 3], ohlc[:, 0], ohlc[:, 1], ohlc[:, 2])


def scan(bars: DataFrame, grid: DataFrame, cost: Costs = Costs()) -> DataFrame:
    """(symbol, strategy, combo_id, ret, dd, trades, score) of every parameter set of ``grid`` on every symbol.

    ``grid``: (strategy, combo_id, params array<double>).  A task reads the bars of a symbol once and
    advances all sets of its part of the grid together.
    """

    def run(batches):
        for pdf in batches:
            for symbol, b, sets in zip(pdf["symbol"], pdf["b"], pdf["sets"], strict=True):
                ids, params = grids_of(sets)
                for strategy, out in backtest_all(bars_from(ohlc_of(b)), params, cost).items():
                    yield pd.DataFrame({"symbol": symbol, "strategy": strategy, "combo_id": ids[strategy], "ret": out["ret"], "dd": out["dd"], "trades": out["trades"], "score": score(out["ret"], out["dd"], out["trades"])})

    work = jobs(bars, grid).repartition("symbol", "deal").select("symbol", "b", "sets")
    return work.mapInPandas(run, "symbol string, strategy string, combo_id int, ret double, dd double, trades long, score double")


def curves(bars: DataFrame, sets: DataFrame, cost: Costs = Costs()) -> DataFrame:
    """(symbol, strategy, combo_id, bar, ts, equity, pos): equity and position after each bar for (strategy, combo_id, params) of few sets; the last with all closed."""

    def run(batches):
        for pdf in batches:
            for symbol, b, some in zip(pdf["symbol"], pdf["b"], pdf["sets"], strict=True):
                ids, params = grids_of(some)
                times = [r["ts"] for r in b]
                for strategy, out in backtest_all(bars_from(ohlc_of(b)), params, cost, path=True).items():
                    for j, combo in enumerate(ids[strategy]):
                        yield pd.DataFrame({"symbol": symbol, "strategy": strategy, "combo_id": combo, "bar": range(len(times)), "ts": times, "equity": out["curve"][:, j], "pos": out["held"][:, j].astype(int)})

    work = jobs(bars, sets).repartition("symbol", "deal").select("symbol", "b", "sets")
    return work.mapInPandas(run, "symbol string, strategy string, combo_id int, bar int, ts timestamp_ntz, equity double, pos int")


def followed(bars: DataFrame, names: list[str], cost: Costs = Costs()) -> DataFrame:
    """(symbol, name, ret, dd, trades): backtests of the given columns of positions of the bars."""
    one = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close", F.array(*[F.col(c).cast("int") for c in names]).alias("want")))).alias("b"))

    def run(batches):
        for pdf in batches:
            for symbol, b in zip(pdf["symbol"], pdf["b"], strict=True):
                out = follow(np.array([r["want"] for r in b]), bars_from(ohlc_of(b)), cost)
                yield pd.DataFrame({"symbol": symbol, "name": names, "ret": out["ret"], "dd": out["dd"], "trades": out["trades"]})

    return one.mapInPandas(run, "symbol string, name string, ret double, dd double, trades long")


def portfolio(equity: DataFrame, weights: DataFrame | None = None, per_year: float = 365.0) -> DataFrame:
    """One row: return, drawdown and Sharpe ratio of the weighted sum of (symbol, bar, equity), over the bars that all symbols have; equal weights unless (symbol, weight) says otherwise."""
    if weights is None:
        symbols = equity.select("symbol").distinct().agg(F.count("*")).scalar()
        joined = equity.withColumn("weight", 1 / symbols)
    else:
        joined = equity.join(weights, "symbol")
    common = joined.groupBy("bar").agg(F.sum(F.col("equity") * F.col("weight")).alias("equity"), F.count("*").alias("n"))
    # bars are numbered from 0, so those with most symbols are the common ones
    most = common.agg(F.max("n").alias("n"))
    whole = common.join(most, "n").select(F.lit("all").alias("symbol"), F.col("bar").alias("ts"), "equity")
    w = Window.partitionBy("symbol").orderBy("ts")
    c = whole.withColumn("r", F.col("equity") / F.greatest(F.lag("equity").over(w), F.lit(1e-10)) - 1).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.agg(((F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1) * 100).alias("ret"), (F.max(1 - F.col("equity") / F.col("peak")) * 100).alias("dd"), (F.avg("r") / F.stddev_pop("r") * per_year**0.5).alias("sharpe"), F.count("*").alias("bars"))


def best(scanned: DataFrame) -> DataFrame:
    """The set with the highest score of each symbol and strategy; the earlier one of equals."""
    return scanned.groupBy("symbol", "strategy").agg(F.max_by(F.struct("combo_id", "ret", "dd", "trades", "score"), F.struct("score", -F.col("combo_id"))).alias("x")).select("symbol", "strategy", "x.*")
