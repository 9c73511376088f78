"""Indicators named by a list or a configuration, as one plan.

Bars are numbered and cut into blocks once.  Frames of rows are windows within a
block that has the last rows of the block before in front; recurrences are two scans
of affine maps.  So no task walks a series, whichever indicators are asked for, and
bars are shuffled once by block, not once by indicator.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .affine import PER_BLOCK, ema, in_block, masked, numbered, solved, strength, true_range, wilder, with_tail

#: What is computed where nothing is named.
DEFAULT = {"ma": [5, 10, 20], "rsi": {"period": 14}, "macd": {"fast": 12, "slow": 26, "signal": 9}, "bb": {"period": 20, "std": 2}, "atr": {"period": 14}, "cci": {"period": 20}, "willr": {"period": 14}, "stoch": {"k_period": 14, "d_period": 3}, "adx": {"period": 14}}
#: Indicators of the high and low; bars without these columns do without them.
OF_RANGE = ("atr", "cci", "willr", "stoch", "adx")
PRICES = ["open", "high", "low", "close", "volume"]


def parsed(names: Iterable[str]) -> dict:
    """The configuration of names as ``ma20``, ``rsi``, ``rsi7``, ``macd`` or ``bb``; a number is the period, other names are passed over."""
    out: dict = {}
    for name in names:
        found = re.fullmatch(r"([a-z]+?)(\d*)", name)
        kind, n = found.groups() if found else ("", "")
        if kind == "ma" and n:
            out.setdefault("ma", []).append(int(n))
        elif kind in DEFAULT and kind != "ma":
            period = "k_period" if kind == "stoch" else "period"
            out[kind] = DEFAULT[kind] | ({period: int(n)} if n and kind != "macd" else {})
    return out


def _settings(config: dict, columns: list[str]) -> dict:
    """Whole settings: what is left out is the default, a bare number is the period."""
    out = {}
    for kind, given in config.items():
        if kind not in DEFAULT or (kind in OF_RANGE and not {"high", "low"} <= set(columns)):
            continue
        if kind == "ma":
            out["ma"] = sorted({int(n) for n in given if int(n) > 0})
        else:
            bare = {} if isinstance(given, dict) or kind == "macd" else {"k_period" if kind == "stoch" else "period": int(given)}
            out[kind] = DEFAULT[kind] | (given if isinstance(given, dict) else bare)
    return out


def _behind(c: dict) -> int:
    """Rows before a block that its frames reach back to."""
    frames = [1, *c.get("ma", [])]
    frames += [c[k]["period"] for k in ("bb", "atr", "cci", "willr") if k in c]
    if "stoch" in c:
        frames.append(c["stoch"]["k_period"] + c["stoch"]["d_period"])
    return max(frames)


def _framed(rows: DataFrame, c: dict) -> tuple[DataFrame, list[str]]:
    """Indicators of frames, and what the recurrences take; the names of the former."""
    w, i, close = in_block(), F.col("i"), F.col("close")
    before = F.lag("close").over(w)

    def last(n: int) -> object:
        return w.rowsBetween(1 - n, 0)

    def place(n: int, flat: float, up: bool) -> Column:
        """Where the close lies between the lowest and the highest of ``n``."""
        hh, ll = F.max("high").over(last(n)), F.min("low").over(last(n))
        span = F.nullif(hh - ll, F.lit(0.0))
        return F.when(i >= n - 1, F.coalesce(100 * (close - ll) / span if up else -100 * (hh - close) / span, F.lit(flat)))

    first, then = {}, {f"ma{n}": F.when(i >= n - 1, F.avg("close").over(last(n))) for n in c.get("ma", [])}
    if "rsi" in c:
        first["__step"] = F.coalesce(close - before, F.lit(0.0))
    if "atr" in c or "adx" in c:
        first["__tr"] = true_range(before)
    if "adx" in c:
        first |= {"__u": F.coalesce(F.col("high") - F.lag("high").over(w), F.lit(0.0)), "__d": F.coalesce(F.lag("low").over(w) - F.col("low"), F.lit(0.0))}
    if "bb" in c:
        n, k = c["bb"]["period"], c["bb"]["std"]
        mid, wide = F.avg("close").over(last(n)), k * F.stddev_pop("close").over(last(n))
        then |= {"bb_upper": F.when(i >= n - 1, mid + wide), "bb_middle": F.when(i >= n - 1, mid), "bb_lower": F.when(i >= n - 1, mid - wide)}
    if "atr" in c:
        n = c["atr"]["period"]
        then["atr"] = F.when(i >= n - 1, F.avg("__tr").over(last(n)))
    if "willr" in c:
        then["willr"] = place(c["willr"]["period"], -50.0, False)
    if "stoch" in c:
        k, d = c["stoch"]["k_period"], c["stoch"]["d_period"]
        first["stoch_k"] = place(k, 50.0, True)
        then["stoch_d"] = F.when(i >= k + d - 2, F.avg("stoch_k").over(last(d)))
    if "cci" in c:
        n = c["cci"]["period"]
        first["__tp"] = (F.col("high") + F.col("low") + close) / 3
        then |= {"__tps": F.collect_list("__tp").over(last(n)), "__mean": F.avg("__tp").over(last(n))}
    rows = rows.withColumns(first).withColumns(then)
    if "cci" in c:
        n = c["cci"]["period"]
        off = F.aggregate("__tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__mean"))) / n
        cci = F.when(off < 1e-12, 0.0).otherwise((F.col("__tp") - F.col("__mean")) / (0.015 * F.nullif(off, F.lit(0.0))))
        rows = rows.withColumn("cci", F.when(i >= n - 1, cci)).drop("__tps", "__mean", "__tp")
    names = [k for k in (*first, *then, *(["cci"] if "cci" in c else [])) if not k.startswith("__")]
    return rows, names


def _recurred(rows: DataFrame, c: dict, per_block: int, blocks: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the averages that the recursive indicators are made of, and those indicators."""
    close, maps, later, out = F.col("close"), {}, {}, {}
    if "rsi" in c:
        n, step = c["rsi"]["period"], F.col("__step")
        maps |= {"__up": wilder(F.greatest(step, F.lit(0.0)), n, 1, n), "__down": wilder(F.greatest(-step, F.lit(0.0)), n, 1, n)}
        out["rsi"] = masked(strength(F.col("__up"), F.col("__down")), n)
    if "macd" in c:
        m = c["macd"]
        maps |= {"__fast": ema(close, m["fast"]), "__slow": ema(close, m["slow"])}
        line = F.col("__fast") - F.col("__slow")
        later["macd_signal"] = ema(line, m["signal"])
        out |= {"macd": line, "macd_signal": F.col("macd_signal"), "macd_hist": line - F.col("macd_signal")}
    if "adx" in c:
        n, u, d = c["adx"]["period"], F.col("__u"), F.col("__d")
        moves = {"__st": F.col("__tr"), "__sp": F.when((u > d) & (u > 0), u).otherwise(0.0), "__sm": F.when((d > u) & (d > 0), d).otherwise(0.0)}
        maps |= {k: wilder(x, n, 1, n - 1) for k, x in moves.items()}
        whole = F.nullif(F.col("__st"), F.lit(0.0))
        p, m = 100 * F.col("__sp") / whole, 100 * F.col("__sm") / whole
        dx = F.when(p + m > 0, 100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))).otherwise(0.0)
        later["__adx"] = wilder(dx, n, n, 2 * n - 1)
        out["adx"] = masked(F.col("__adx"), 2 * n - 1)
    for some in (maps, later):
        rows = solved(rows, some, per_block=per_block, blocks=blocks) if some else rows
    return rows, out


def indicators(bars: DataFrame, config: dict | Iterable[str] | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """Bars (symbol, ts, prices) with the columns of ``config``, which is a configuration, names for ``parsed``, or None for DEFAULT.

    Columns are null until warmed up.  Columns of ``bars`` other than prices are not read; a
    symbol's times must differ; an empty table gives no rows.
    """
    given = DEFAULT if config is None else config if isinstance(config, dict) else parsed(config)
    prices = [c for c in PRICES if c in bars.columns]
    c = _settings(given, prices)
    behind = _behind(c)
    per_block = max(per_block, behind)
    bars = bars.select("symbol", "ts", *prices)
    most = bars.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rows = with_tail(numbered(bars, per_block), behind, per_block)
    framed, names = _framed(rows, c)
    rows, recursive = _recurred(framed.filter("NOT tail"), c, per_block, -(-most // per_block))
    return rows.select("symbol", "ts", *prices, *names, *[v.alias(k) for k, v in recursive.items()])
