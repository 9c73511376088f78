"""Recursive indicators as an associative scan: no series is walked in one task, and no Python runs.

A step of an exponential or a Wilder average is an affine map of the value before,
y -> a y + b, and so are its seeds (a sum that is divided at the end is one, too).
Affine maps compose, so a series is cut into blocks: the maps of a block are
composed for each of its rows by doubling, in one task a block; the compositions
of whole blocks, one row a block, are composed likewise by symbol; and each row
applies its map to what comes into its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
PER_BLOCK = 256

Map = tuple[Column, Column]


def numbered(bars: DataFrame, per_block: int = PER_BLOCK, before: DataFrame | None = None) -> DataFrame:
    """``bars`` with ``i``, the number of a row of its symbol from 0, and ``block``; rows are counted by month and months summed up.

    ``before`` (symbol, n) says how many rows a symbol had already.
    """
    month = F.date_trunc("month", "ts")
    own = F.row_number().over(Window.partitionBy("symbol", "__month").orderBy("ts")) - 1
    rows = bars.withColumn("__month", month).withColumn("__own", own)
    earlier = Window.partitionBy("symbol").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("symbol", "__month").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    if before is not None:
        first = first.join(before.select("symbol", F.col("n").alias("__n")), "symbol", "left").withColumn("__first", F.col("__first") + F.coalesce("__n", F.lit(0))).drop("__n")
    out = rows.join(first, ["symbol", "__month"]).withColumn("i", F.col("__first") + F.col("__own"))
    return out.withColumn("block", F.floor(F.col("i") / per_block)).drop("__month", "__own", "__first")


def with_tail(rows: DataFrame, n: int, per_block: int = PER_BLOCK) -> DataFrame:
    """Rows with the last ``n`` of the block before in front of each block, so that frames of ``n`` rows back are whole; ``tail`` marks them."""
    if n > per_block:
        raise ValueError("a frame is longer than a block")
    late = F.col("i") % per_block >= per_block - n
    to = F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__to")
    return rows.select("*", to).withColumn("block", F.col("block") + F.col("__to")).withColumn("tail", F.col("__to") == 1).drop("__to")


def in_block() -> Window:
    return Window.partitionBy("symbol", "block").orderBy("i")


def _composed(df: DataFrame, names: list[str], w: Window, most: int) -> DataFrame:
    """Each row's maps (``__a_``, ``__b_`` and a name) after those of up to ``most`` rows before it, by doubling."""
    step = 1
    while step < most:
        df = df.select("*", *[F.lag(f"__{c}_{k}", step).over(w).alias(f"__p{c}_{k}") for k in names for c in "ab"])
        changed = {}
        for k in names:
            a, b = F.col(f"__a_{k}"), F.col(f"__b_{k}")
            changed[f"__b_{k}"] = a * F.coalesce(f"__pb_{k}", F.lit(0.0)) + b
            changed[f"__a_{k}"] = a * F.coalesce(f"__pa_{k}", F.lit(1.0))
        df = df.withColumns(changed).drop(*[f"__p{c}_{k}" for k in names for c in "ab"])
        step *= 2
    return df


def solved(rows: DataFrame, maps: dict[str, Map], start: DataFrame | None = None, per_block: int = PER_BLOCK, blocks: int | None = None) -> DataFrame:
    """``rows`` (symbol, i, block) with the value of each recurrence; it starts from 0, or from those of ``start`` (symbol, values by name).

    ``blocks`` is at least the number of blocks of a symbol, and is counted where it is not known.
    """
    names = list(maps)
    df = rows.withColumns({f"__{c}_{k}": m.cast("double") for k, pair in maps.items() for c, m in zip("ab", pair, strict=True)})
    df = _composed(df, names, in_block(), per_block)
    last = F.max_by(F.struct(*[f"__{c}_{k}" for k in names for c in "ab"]), "i").alias("e")
    ends = df.groupBy("symbol", "block").agg(last).select("symbol", "block", "e.*")
    if blocks is None:
        blocks = ends.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    w = Window.partitionBy("symbol").orderBy("block")
    ends = _composed(ends, names, w, blocks)
    ends = ends.select("symbol", "block", *[F.lag(f"__{c}_{k}").over(w).alias(f"__p{c}_{k}") for k in names for c in "ab"])
    if start is not None:
        ends = ends.join(start.select("symbol", *[F.col(k).alias(f"__s_{k}") for k in names]), "symbol", "left")
    into = []
    for k in names:
        first = F.coalesce(f"__s_{k}", F.lit(0.0)) if start is not None else F.lit(0.0)
        into.append((F.coalesce(f"__pa_{k}", F.lit(1.0)) * first + F.coalesce(f"__pb_{k}", F.lit(0.0))).alias(f"__in_{k}"))
    joined = df.join(ends.select("symbol", "block", *into), ["symbol", "block"])
    return joined.select(*rows.columns, *[(F.col(f"__a_{k}") * F.col(f"__in_{k}") + F.col(f"__b_{k}")).alias(k) for k in names])


# ---- the maps of averages ----


def ema(x: Column, n: int) -> Map:
    """From the first value on, alpha = 2 / (n + 1)."""
    alpha, first = 2 / (n + 1), F.col("i") == 0
    return F.when(first, 0.0).otherwise(1 - alpha), F.when(first, x).otherwise(alpha * x)


def wilder(x: Column, n: int, first: int, last: int) -> Map:
    """The mean of the values from row ``first`` to ``last``, and from there on Wilder's average of ``n``."""
    i, m = F.col("i"), last - first + 1
    a = F.when(i <= first, 0.0).when(i < last, 1.0).when(i == last, 1.0 / m).otherwise(1 - 1 / n)
    b = F.when(i < first, 0.0).when(i < last, x).when(i == last, x / m).otherwise(x / n)
    return (a, b) if m > 1 else (F.when(i <= last, 0.0).otherwise(1 - 1 / n), F.when(i < last, 0.0).when(i == last, x).otherwise(x / n))


def masked(value: Column, begin: int) -> Column:
    return F.when(F.col("i") >= begin, value)


def true_range(before: Column) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))


# ---- indicators: (symbol, ts, columns), null until warmed up ----


def ema_pair(bars: DataFrame, per_block: int = PER_BLOCK, fast: int = 10, slow: int = 20) -> DataFrame:
    c = F.col("close")
    out = solved(numbered(bars, per_block), {f"ema{fast}": ema(c, fast), f"ema{slow}": ema(c, slow)}, per_block=per_block)
    return out.select("symbol", "ts", f"ema{fast}", f"ema{slow}")


def macd(bars: DataFrame, per_block: int = PER_BLOCK, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    c = F.col("close")
    line = solved(numbered(bars, per_block), {"__f": ema(c, fast), "__s": ema(c, slow)}, per_block=per_block).withColumn("macd", F.col("__f") - F.col("__s"))
    out = solved(line, {"macd_signal": ema(F.col("macd"), signal)}, per_block=per_block)
    return out.select("symbol", "ts", "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))


def rsi(bars: DataFrame, per_block: int = PER_BLOCK, n: int = 14) -> DataFrame:
    rows = with_tail(numbered(bars, per_block), 1, per_block).withColumn("__step", F.coalesce(F.col("close") - F.lag("close").over(in_block()), F.lit(0.0))).filter("NOT tail")
    up, down = F.greatest(F.col("__step"), F.lit(0.0)), F.greatest(-F.col("__step"), F.lit(0.0))
    out = solved(rows, {"__up": wilder(up, n, 1, n), "__down": wilder(down, n, 1, n)}, per_block=per_block)
    return out.select("symbol", "ts", masked(strength(F.col("__up"), F.col("__down")), n).alias("rsi"))


def atr(bars: DataFrame, per_block: int = PER_BLOCK, n: int = 14) -> DataFrame:
    rows = with_tail(numbered(bars, per_block), 1, per_block).withColumn("__tr", true_range(F.lag("close").over(in_block()))).filter("NOT tail")
    out = solved(rows, {"atr": wilder(F.col("__tr"), n, 0, n - 1)}, per_block=per_block)
    return out.select("symbol", "ts", masked(F.col("atr"), n - 1).alias("atr"))


def adx(bars: DataFrame, per_block: int = PER_BLOCK, n: int = 14) -> DataFrame:
    w = in_block()
    rows = with_tail(numbered(bars, per_block), 1, per_block)
    up, down = F.coalesce(F.col("high") - F.lag("high").over(w), F.lit(0.0)), F.coalesce(F.lag("low").over(w) - F.col("low"), F.lit(0.0))
    rows = rows.withColumns({"__u": up, "__d": down, "__tr": true_range(F.lag("close").over(w))}).filter("NOT tail")
    plus = F.when((F.col("__u") > F.col("__d")) & (F.col("__u") > 0), F.col("__u")).otherwise(0.0)
    minus = F.when((F.col("__d") > F.col("__u")) & (F.col("__d") > 0), F.col("__d")).otherwise(0.0)
    smooth = solved(rows, {f"__s{k}": wilder(x, n, 1, n - 1) for k, x in (("t", F.col("__tr")), ("p", plus), ("m", minus))}, per_block=per_block)
    t = F.nullif(F.col("__st"), F.lit(0.0))
    p, m = 100 * F.col("__sp") / t, 100 * F.col("__sm") / t
    dx = F.when(p + m > 0, 100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))).otherwise(0.0)
    out = solved(smooth.withColumn("__dx", dx), {"adx": wilder(F.col("__dx"), n, n, 2 * n - 1)}, per_block=per_block)
    return out.select("symbol", "ts", masked(F.col("adx"), 2 * n - 1).alias("adx"))


def kama(bars: DataFrame, per_block: int = PER_BLOCK, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    w = in_block()
    rows = with_tail(numbered(bars, per_block), n + 1, per_block).withColumn("__move", F.abs(F.col("close") - F.lag("close").over(w)))
    path = F.sum("__move").over(w.rowsBetween(1 - n, 0))
    rows = rows.withColumns({"__path": path, "__far": F.abs(F.col("close") - F.lag("close", n).over(w))}).filter("NOT tail")
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    ratio = F.when(F.col("__path") > 0, F.col("__far") / F.nullif(F.col("__path"), F.lit(0.0))).otherwise(0.0)
    rate, i, c = F.pow(ratio * (a - b) + b, F.lit(2)), F.col("i"), F.col("close")
    step = F.when(i < n, 0.0).otherwise(1 - rate), F.when(i < n - 1, 0.0).when(i == n - 1, c).otherwise(rate * c)
    out = solved(rows, {"kama": step}, per_block=per_block)
    return out.select("symbol", "ts", masked(F.col("kama"), n - 1).alias("kama"))


INDICATORS = {"ema": ema_pair, "rsi": rsi, "macd": macd, "atr_wilder": atr, "adx": adx, "kama": kama}


def charted(rows: DataFrame, order: str, averages: tuple[int, ...] = (20, 50), per_block: int = PER_BLOCK) -> DataFrame:
    """(symbol, x, label, prices, ma…) for a chart without gaps: whole rows, of equal time the last by ``order``, numbered from 0, with moving averages."""
    prices = ["open", "high", "low", "close"]
    last = F.max_by(F.struct(*prices), order).alias("p")
    bars = rows.dropna(subset=["ts", *prices]).groupBy("symbol", "ts").agg(last).select("symbol", "ts", "p.*")
    framed = with_tail(numbered(bars, per_block), max(averages), per_block)
    w = in_block()
    means = {f"ma{n}": F.when(F.col("i") >= n - 1, F.avg("close").over(w.rowsBetween(1 - n, 0))) for n in averages}
    return framed.withColumns(means).filter("NOT tail").select("symbol", F.col("i").alias("x"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"), *prices, *means)
