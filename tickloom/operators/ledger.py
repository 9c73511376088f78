"""Accounts from trades: positions with average entries, a paper broker, breakers, schedules of child orders.

An account is a fold over its trades in order, written as ``aggregate`` over the sorted trades of
one account, so it runs inside the JVM; accounts are the unit of parallel work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "ok", "ln", "side", "shares", "price", "commission"]
_EMPTY = 1e-12


def _trades() -> Column:
    return F.array_sort(F.collect_list(F.struct(*ORDER)))


def entry_after(held: Column, entry: Column, signed: Column, price: Column) -> Column:
    """The average entry price: adding moves it, reducing keeps it, crossing zero starts anew."""
    now = held + signed
    added = (entry * F.abs(held) + price * F.abs(signed)) / F.when(F.abs(now) < _EMPTY, 1.0).otherwise(F.abs(now))
    return F.when(F.abs(now) < _EMPTY, 0.0).when(held * signed >= 0, added).when(now * held < 0, price).otherwise(entry)


def replayed(trades: DataFrame, account: str, cash: float = 0.0) -> DataFrame:
    """(account, cash, position, entry, n): what the trades of each account leave."""
    start = F.struct(F.lit(float(cash)).alias("cash"), F.lit(0.0).alias("position"), F.lit(0.0).alias("entry"), F.lit(0).cast("long").alias("n"))

    def step(a, t):
        signed = F.when(t["side"] == "buy", t["shares"]).otherwise(-t["shares"])
        now = a["position"] + signed
        return F.struct((a["cash"] - signed * t["price"] - t["commission"]).alias("cash"), F.when(F.abs(now) < _EMPTY, 0.0).otherwise(now).alias("position"), entry_after(a["position"], a["entry"], signed, t["price"]).alias("entry"), (a["n"] + 1).alias("n"))

    return trades.groupBy(account).agg(F.aggregate(_trades(), start, step).alias("a")).select(account, "a.*")


def paper(trades: DataFrame, account: str, cash: float, bps: float = 5.0, fee: float = 0.001, leverage: float = 2.0, least: float = 10_000.0) -> DataFrame:
    """(account, cash, position, entry, filled, rejected): every order at once at its price moved by ``bps``.

    Orders below ``least`` in value or, for buys, beyond the margin are rejected; sells are cut to what is held, as there are no shorts.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(float(cash)).alias("cash"), F.lit(0.0).alias("position"), F.lit(0.0).alias("entry"), zero.alias("filled"), zero.alias("rejected"))

    def step(a, t):
        buy = t["side"] == "buy"
        price = t["price"] * F.when(buy, 1 + bps / 1e4).otherwise(1 - bps / 1e4)
        shares = F.when(buy, t["shares"]).otherwise(F.least(t["shares"], a["position"]))
        value = price * shares
        need = value / leverage + value * fee
        good = (shares > 0) & (value >= least) & (~buy | (a["cash"] >= need))
        signed = F.when(buy, shares).otherwise(-shares)
        spent = F.when(buy, need).otherwise(-(value - value * fee))
        now = a["position"] + signed
        return F.struct(
            F.when(good, a["cash"] - spent).otherwise(a["cash"]).alias("cash"),
            F.when(~good, a["position"]).when(F.abs(now) < _EMPTY, 0.0).otherwise(now).alias("position"),
            F.when(good, entry_after(a["position"], a["entry"], signed, price)).otherwise(a["entry"]).alias("entry"),
            F.when(good, a["filled"] + 1).otherwise(a["filled"]).alias("filled"),
            F.when(good, a["rejected"]).otherwise(a["rejected"] + 1).alias("rejected"),
        )

    return trades.groupBy(account).agg(F.aggregate(_trades(), start, step).alias("a")).select(account, "a.*")


def broken(pnl: DataFrame, account: str, limit: float) -> DataFrame:
    """(account, ok, ln, tripped): whether the breaker was open before each trade: from the first whose day has lost more than ``limit`` on, as only a person resets it."""
    day = Window.partitionBy(account, F.to_date("ts")).orderBy("ts", "ok", "ln", "shares", "price").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(account).orderBy("ts", "ok", "ln", "shares", "price").rowsBetween(Window.unboundedPreceding, -1)
    lost = pnl.withColumn("_lost", F.round(F.sum("pnl").over(day), 6) < -limit)
    return lost.select(account, "ok", "ln", F.coalesce(F.max("_lost").over(before), F.lit(False)).alias("tripped"))


def capped(trades: DataFrame, bucket: Column, cap: Column) -> DataFrame:
    """``trades`` with ``filled``: what each gets of the liquidity of its symbol and bucket, first come first served."""
    w = Window.partitionBy("symbol", bucket).orderBy("ts", "ok", "ln", "shares", "price").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("shares").over(w)
    return trades.withColumn("filled", F.least(upto, cap) - F.least(upto - F.col("shares"), cap))


def iceberg(orders: DataFrame, share: float = 0.1) -> DataFrame:
    """Orders (id, qty) as child orders (id, slice, shares): the shown part again and again, the rest at the end."""
    shown = F.greatest(F.round(F.col("qty") * share, 8), F.col("qty") / 100)
    n = F.ceil(F.round(F.col("qty") / shown, 9)).cast("int")
    rows = orders.withColumn("shown", shown).withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("id", "slice", F.least(F.col("shown"), F.col("qty") - F.col("shown") * F.col("slice")).alias("shares"))


def chased(orders: DataFrame, tick: float, retries: int) -> DataFrame:
    """Orders (id, side, price) as the prices (id, attempt, price) at which a limit order follows the market."""
    way = F.when(F.col("side") == "buy", 1).otherwise(-1)
    rows = orders.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))
    return rows.select("id", "attempt", (F.col("price") + way * F.col("attempt") * tick).alias("price"))
