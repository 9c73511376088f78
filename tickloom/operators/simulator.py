"""Orders against bars: a simulator at the level of single orders, one symbol's run a group.

Each bar: orders past their time go; open orders fill by priority within the bar's liquidity; funding and borrow
are paid; protective exits become market orders; orders of this bar join; cash, position and equity are recorded.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

BARS = "symbol string, bar int, ts timestamp_ntz, cash double, position double, entry double, equity double, fees double, open_orders int"
FILLS = "symbol string, bar int, order_id long, side string, shares double, price double, fee double, reason string"


@dataclass(frozen=True)
class Rules:
    cash: float = 1_000_000.0
    slip_bps: float = 5.0
    commission: float = 0.0003
    impact_bps: float = 0.0
    impact_power: float = 0.5
    liquidity: float = 1.0  # share of a bar's volume that may be taken
    shorts: bool = True
    funding: float = 0.0  # a bar, of the position's entry value
    borrow: float = 0.0  # a bar, of a short position's value
    stop: float | None = None
    target: float | None = None
    trail: float | None = None


def matched(kind: str, buy: bool, limit: float, stop: float, o: float, h: float, low: float) -> float | None:
    """The price at which an open order fills in a bar, if it does."""
    if kind == "market":
        return o
    if kind == "stop":
        reached = h >= stop if buy else low <= stop
        return (max(o, stop) if buy else min(o, stop)) if reached else None
    if (low > limit) if buy else (h < limit):
        return None
    return (min(o, limit) if buy else max(o, limit)) if likely(limit, buy, h, low) >= 0.5 else None


def likely(limit: float, buy: bool, h: float, low: float) -> float:
    """How likely a limit order's turn comes: from 0.3 at the bar's edge to 1 across it."""
    if h - low < 1e-10:
        return 1.0
    inside = (limit - low if buy else h - limit) / (h - low)
    # fixed values: the chance at the edge, and what a full crossing adds
    return 0.3 + 0.7 * min(1.0, max(0.0, inside))


class Account:
    def __init__(self, cash: float) -> None:
        self.cash, self.held, self.entry, self.best, self.fees = cash, 0.0, 0.0, 0.0, 0.0

    def fill(self, signed: float, price: float, fee: float) -> None:
        """Adding moves the average entry, reducing keeps it, crossing zero starts anew at the price."""
        now = self.held + signed
        if self.held * signed >= 0:
            self.entry = (self.entry * abs(self.held) + price * abs(signed)) / abs(now) if now else 0.0
        elif now * self.held < 0:
            self.entry = price
        if self.held * now <= 0:
            self.best = price
        self.cash -= signed * price + fee
        self.fees += fee
        self.held = now if abs(now) > 1e-12 else 0.0

    def exit_reason(self, price: float, r: Rules) -> str | None:
        if not self.held or price <= 0:
            return None
        side = 1 if self.held > 0 else -1
        self.best = max(self.best, price) if side > 0 else min(self.best, price)
        gain = price / self.entry - 1 if side > 0 else self.entry / price - 1
        if r.trail is not None and side * (self.best - price) / self.best >= r.trail:
            return "trail"
        if r.stop is not None and gain <= -r.stop:
            return "stop"
        return "target" if r.target is not None and gain >= r.target else None


def replay(symbol: str, bars: pd.DataFrame, orders: pd.DataFrame, r: Rules) -> tuple[list, list]:
    """Rows of ``BARS`` and ``FILLS`` for one symbol."""
    due: dict = {}
    for x in orders.sort_values(["bar", "order_id"]).itertuples(index=False):
        due.setdefault(int(x.bar), []).append({"id": int(x.order_id), "buy": x.side == "buy", "kind": x.kind, "left": float(x.shares), "limit": x.limit_price, "stop": x.stop_price, "tif": x.tif_bars, "at": int(x.bar), "why": "order", "cancel": x.side == "cancel"})
    account, open_, states, fills = Account(r.cash), [], [], []
    for i, b in enumerate(bars.sort_values("ts").itertuples(index=False)):
        open_ = [x for x in open_ if pd.isna(x["tif"]) or i - x["at"] <= x["tif"]]
        room = b.volume * r.liquidity
        # better limits first, then the earlier order
        for x in sorted(open_, key=lambda x: (0.0 if x["kind"] != "limit" else -x["limit"] if x["buy"] else x["limit"], x["at"], x["id"])):
            price = matched(x["kind"], x["buy"], x["limit"], x["stop"], b.open, b.high, b.low)
            shares = min(x["left"], room)
            if price is None or shares <= 0:
                continue
            sign = 1 if x["buy"] else -1
            moved = r.slip_bps + r.impact_bps * min(1.0, shares / b.volume) ** r.impact_power
            price = max(0.0, price * (1 + sign * moved / 1e4))
            if x["buy"] and account.held >= 0:
                shares = min(shares, max(0.0, account.cash) / (price * (1 + r.commission))) if price else shares
            elif not x["buy"] and not r.shorts:
                shares = min(shares, max(0.0, account.held))
            if shares <= 0:
                continue
            fee = shares * price * r.commission
            account.fill(sign * shares, price, fee)
            fills.append((symbol, i, x["id"], "buy" if x["buy"] else "sell", shares, price, fee, x["why"]))
            room -= shares
            x["left"] -= shares
        open_ = [x for x in open_ if x["left"] > 1e-12]
        account.cash -= abs(account.held) * account.entry * r.funding + max(0.0, -account.held) * b.close * r.borrow
        why = account.exit_reason(b.close, r)
        if why and not any(x["why"] != "order" for x in open_):
            open_.append({"id": -1, "buy": account.held < 0, "kind": "market", "left": abs(account.held), "limit": None, "stop": None, "tif": None, "at": i, "why": why})
        for x in due.get(i, []):
            if x["cancel"]:
                open_ = [y for y in open_ if y["id"] != x["id"]]
            else:
                open_.append(x)
        states.append((symbol, i, b.ts, account.cash, account.held, account.entry, account.cash + account.held * b.close, account.fees, len(open_)))
    return states, fills


def _simulated(bars: DataFrame, orders: DataFrame, rules: Rules, which: int, schema: str) -> DataFrame:
    def run(key: tuple, b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(replay(key[0], b, o, rules)[which], columns=[x.split()[0] for x in schema.split(", ")])

    return bars.groupBy("symbol").cogroup(orders.groupBy("symbol")).applyInPandas(run, schema)


def states(bars: DataFrame, orders: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Cash, position and equity after each bar.

    ``orders``: symbol, bar (the number, from 0, of the bar whose close gives it), order_id, side (buy, sell, cancel),
    kind (market, limit, stop), shares, limit_price, stop_price, tif_bars (null: until cancelled).
    """
    return _simulated(bars, orders, rules, 0, BARS)


def fills(bars: DataFrame, orders: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return _simulated(bars, orders, rules, 1, FILLS)
