"""Streams of ticks and bars: ordering, bars, online features, position changes, stops."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, glob: str = "*", files: int = 100) -> DataFrame:
    """New Parquet files below ``path``, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)


def closed(bars: DataFrame) -> DataFrame:
    """Bars that the feed has marked as closed."""
    return bars.filter("is_closed").drop("is_closed")


def tumbling(ticks: DataFrame, every: str, late: str | None = None) -> DataFrame:
    """OHLCV bars from (symbol, ts, price, size, seq); with ``late``, a watermark drops bars older than that.

    A watermark needs a ``timestamp`` column; without one the state keeps a row for each bar.
    """
    t = ticks.withWatermark("ts", late) if late else ticks
    at = F.struct("ts", "seq")
    out = t.groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Rows that are handed on at once.
PER_YIELD = 10_000


def _stateful(rows: DataFrame, output: str, state: str, first: tuple, step: Callable, order: list[str], reads: list[str]) -> DataFrame:
    """``step(state, row)`` gives the new state and a row or None, per symbol, in ``order`` within a batch.

    Of a batch a task holds the columns ``reads`` and ``order`` of one symbol as arrays, and rows of ``PER_YIELD`` only.
    """
    order = [c for c in order if c in rows.columns]
    kept = list(dict.fromkeys([*reads, *order]))
    fields, most = [x.split() for x in output.split(", ")], PER_YIELD
    doubles = [k for k, (_, kind) in enumerate(fields) if kind == "double"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else first
        found: dict[str, list] = {c: [] for c in kept}
        for part in parts:
            for c in kept:
                found[c].append(part[c].to_numpy(copy=True))
        whole = {c: np.concatenate(found.pop(c)) for c in kept}
        at = np.lexsort([whole[c] for c in reversed(order)])
        for start in range(0, len(at), most):
            some = at[start : start + most]
            out = []
            for row in pd.DataFrame({c: v[some] for c, v in whole.items()}).itertuples(index=False):
                now, made = step(now, row)
                if made is not None:
                    made = (key[0], *made)
                    # pandas takes NaN for null, so NaN are marked
                    out.append((*made, sum(1 << k for k in doubles if made[k] != made[k])))
            if out:
                yield pd.DataFrame(out, columns=[*[n for n, _ in fields], "marks"])
        held.update(now)

    out = rows.select("symbol", *kept).groupBy("symbol").applyInPandasWithState(run, f"{output}, marks long", state, "append", GroupStateTimeout.NoTimeout)
    return out.select(*[F.when(F.getbit("marks", F.lit(k)) == 1, math.nan).otherwise(F.col(n)).alias(n) if k in doubles else F.col(n) for k, (n, _) in enumerate(fields)])


def in_order(ticks: DataFrame, interval_s: float) -> DataFrame:
    """Rows whose time is after all that came before (by ``seq``); ``gap`` where over 1.5 intervals are missing."""

    def step(now: tuple, row) -> tuple:
        (last,) = now
        at = int(row.ts.value // 1000)
        if last >= at:
            return now, None
        return (at,), (row.ts, row.price, last > 0 and at - last > 1.5e6 * interval_s)

    return _stateful(ticks, "symbol string, ts timestamp_ntz, price double, gap boolean", "last long", (0,), step, ["seq"], ["ts", "price"])


def online_mean(bars: DataFrame, n: int) -> DataFrame:
    """Each bar with the mean of the last ``n`` closes, null before; the state holds ``n`` numbers."""

    def step(now: tuple, row) -> tuple:
        tail = [*now[0], float(row.close)][-n:]
        return (tail,), (row.ts, row.close, sum(tail) / n if len(tail) == n else None)

    return _stateful(bars, "symbol string, ts timestamp_ntz, close double, mean double", "tail array<double>", ([],), step, ["ts", "seq"], ["close"])


def position_changes(positions: DataFrame) -> DataFrame:
    """(symbol, ts, action, intent) where ``pos`` differs from the one before."""

    def step(now: tuple, row) -> tuple:
        was, pos = now[0], int(row.pos)
        if pos == was:
            return now, None
        intent = "close" if pos == 0 else "open" if was == 0 else "reverse"
        return (pos,), (row.ts, "buy" if pos > was else "sell", intent)

    return _stateful(positions, "symbol string, ts timestamp_ntz, action string, intent string", "pos int", (0,), step, ["ts", "seq"], ["pos"])


def stops(ticks: DataFrame, stop: float, take: float) -> DataFrame:
    """The first tick of each long entry (a tick with ``entry`` set) at which a stop or a target is met."""

    def step(now: tuple, row) -> tuple:
        entry = now[0] if pd.isna(row.entry) else float(row.entry)
        if entry <= 0:
            return (0.0,), None
        why = "stop" if row.price <= entry * (1 - stop) else "target" if row.price >= entry * (1 + take) else None
        return ((0.0,), (row.ts, row.price, why)) if why else ((entry,), None)

    return _stateful(ticks, "symbol string, ts timestamp_ntz, price double, reason string", "entry double", (0.0,), step, ["seq"], ["ts", "price", "entry"])


def intervals(ticks: DataFrame, every: dict[str, str]) -> DataFrame:
    """``tumbling`` bars of several intervals, (interval, symbol, ts, ...), from one stream."""
    named = ticks.withColumn("interval", F.explode(F.array(*[F.lit(k) for k in every])))
    at = F.struct("ts", "seq")
    # windows need a fixed length, so the start is arithmetic on the length of the row's interval
    seconds = F.lit(None).cast("long")
    for k, v in every.items():
        seconds = F.when(F.col("interval") == k, F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + INTERVAL {v})")).otherwise(seconds)
    stamp = F.unix_seconds(F.col("ts").cast("timestamp"))
    start = F.timestamp_seconds(stamp - F.pmod(stamp, seconds)).cast("timestamp_ntz")
    out = named.groupBy("interval", "symbol", start.alias("start")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.withColumnRenamed("start", "ts")


def ordering(ticks: DataFrame) -> DataFrame:
    """Every row with whether its time is after all that came before, by ``seq``."""

    def step(now: tuple, row) -> tuple:
        at = int(row.ts.value // 1000)
        return (max(now[0], at),), (row.ts, now[0] < at)

    return _stateful(ticks, "symbol string, ts timestamp_ntz, in_order boolean", "last long", (0,), step, ["seq"], ["ts"])


def online_features(bars: DataFrame, n: int = 14) -> DataFrame:
    """Each bar with its return and Wilder's RSI; the state is the last close, a count and two averages."""

    def step(now: tuple, row) -> tuple:
        last, seen, gain, loss = now
        close = float(row.close) if row.known else None
        if seen == 0:
            return (close, 1, 0.0, 0.0), (row.ts, close, None, None)
        move = None if close is None or last is None else close - last
        # a step from or to a null is none, as in SQL
        up, down = (0.0, 0.0) if move is None else (max(move, 0.0), max(-move, 0.0))
        if seen <= n:  # sums until there are n steps, then averages
            gain, loss = gain + up, loss + down
            if seen == n:
                gain, loss = gain / n, loss / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        rsi = None if seen < n else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        if move is None:
            return (close, seen + 1, gain, loss), (row.ts, close, None, rsi)
        # the close before as the difference, as in SQL: it rounds otherwise where closes differ much
        last = close - move
        ret = close / last - 1 if last else close * math.inf
        return (close, seen + 1, gain, loss), (row.ts, close, ret, rsi)

    known = bars.withColumn("known", F.col("close").isNotNull())
    return _stateful(known, "symbol string, ts timestamp_ntz, close double, ret double, rsi double", "last double, seen long, gain double, loss double", (0.0, 0, 0.0, 0.0), step, ["ts", "seq"], ["close", "known"])


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, into Parquet below ``path``, a folder for each batch.

    A batch that is run again replaces its folder, so its rows are there once; complete
    results replace the earlier ones.  ``result`` reads them.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def result(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``run_to`` has written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
