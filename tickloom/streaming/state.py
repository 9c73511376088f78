"""Streams with typed state and timers: fused positions with a warm start, silent symbols, documents seen before."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps, lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, and then hands them on in order of (at, rank).

    So rows of several files, and of several batches, are seen in order of their time.
    """

    #: Of the rows that are held: names and types besides ``at`` (microseconds) and ``rank``.
    held_fields: list[str] = []
    out_columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(["at long", "rank int", *self.held_fields]))
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        """Further state."""

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Rows of the output for rows (at, rank, ...) in order."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ["at", "rank", *[f.split()[0] for f in self.held_fields]]
        new = [r for part in rows for r in part[names].itertuples(index=False, name=None)]
        if new:
            plain = [tuple(None if v is not None and pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in new]
            self.held.appendList(plain)
            self.handle.registerTimer(min(r[0] for r in plain) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # the first timer that fires takes all that is due, the others then find nothing
        until = timerValues.getCurrentWatermarkInMs()
        every = sorted(tuple(r) for r in self.held.get())
        due = [r for r in every if r[0] // 1000 < until]
        if not due:
            return
        rest = every[len(due) :]
        self.held.clear()
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        out = self.step(key, due)
        if out:
            yield pd.DataFrame(out, columns=self.out_columns)

    def close(self) -> None:
        pass


def majority(positions: list[int], n: int) -> int:
    """The side that more than half of ``n`` positions take, else 0."""
    for side in (1, -1):
        if 2 * sum(1 for p in positions if p * side > 0) > n:
            return side
    return 0


class Fusion(InOrder):
    """One position of a symbol from those of its intervals, and the orders where it changes.

    The state is a map of interval to position and the fused position.  It starts
    from the initial state, where the fused position is the majority whatever the mode.
    """

    held_fields = ["interval string", "pos int", "close double"]
    out_columns = ["symbol", "at", "interval", "action", "intent", "close"]

    def __init__(self, intervals: list[str], mode: str, primary: str | None = None) -> None:
        if mode not in ("trend_filter", "consensus", "primary"):
            raise ValueError(f"unknown mode {mode}")
        self.intervals, self.mode, self.primary = intervals, mode, primary or intervals[0]

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.positions = handle.getMapState("positions", "interval string", "pos int")
        self.fused = handle.getValueState("fused", "pos int")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for interval, pos in initialState[["interval", "pos"]].itertuples(index=False, name=None):
            if interval in self.intervals:
                self.positions.updateValue((interval,), (int(pos),))
        now = [v[0] for v in self.positions.values()]
        self.fused.update((majority(now, len(self.intervals)),))

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.positions.iterator()}
        fused = self.fused.get()[0] if self.fused.exists() else 0
        out = []
        for at, _, interval, pos, close in rows:
            if interval not in self.intervals:
                continue
            was = held.get(interval, 0)
            held[interval] = pos
            turn = (pos > was) - (pos < was)
            to = self.target(held, interval, turn, fused)
            if self.mode == "primary":
                if interval == self.primary and turn:
                    out.append((key[0], at, interval, "buy" if turn > 0 else "sell", "close" if pos == 0 else "open" if was == 0 else "reverse", close))
            elif to is not None and to != fused:
                out.append((key[0], at, interval, "buy" if to > fused else "sell", "close" if to == 0 else "open" if fused == 0 else "reverse", close))
                fused = to
        for interval, pos in held.items():
            self.positions.updateValue((interval,), (pos,))
        self.fused.update((fused,))
        return out

    def target(self, held: dict[str, int], interval: str, turn: int, fused: int) -> int | None:
        """Where the fused position goes, None if the row has no say."""
        if self.mode == "consensus":
            return majority(list(held.values()), len(self.intervals))
        trend = held.get(self.intervals[-1], 0)
        side = (trend > 0) - (trend < 0)
        if interval == self.intervals[-1]:
            return side
        if not turn:
            return None
        if side == 0:
            return 0
        return side if turn == side else None


def fused(rows: DataFrame, intervals: list[str], mode: str, late: str = "1 hour", primary: str | None = None, warm: DataFrame | None = None) -> DataFrame:
    """(symbol, at, interval, action, intent, close) from a stream (symbol, ts timestamp, interval, pos, close).

    ``intervals`` go from the shortest to the longest.  Rows are taken in order of time, shorter intervals first,
    when ``late`` has passed; ``warm`` (symbol, interval, pos) is the batch table that a new stream starts from.
    """
    prepared(rows.sparkSession)
    rank = F.array_position(F.array(*[F.lit(i) for i in intervals]), F.col("interval")).cast("int")
    keyed = rows.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), rank.alias("rank"), "interval", F.col("pos").cast("int"), F.col("close").cast("double"))
    schema = "symbol string, at long, interval string, action string, intent string, close double"
    first = None if warm is None else warm.select("symbol", "interval", F.col("pos").cast("int")).groupBy("symbol")
    return keyed.groupBy("symbol").transformWithStateInPandas(Fusion(intervals, mode, primary), schema, "append", "EventTime", first)


class Silence(StatefulProcessor):
    """Reports a key for which the time of all has moved on by ``limit_ms`` since its last row, once, and when it is back."""

    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, silent boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(part["at"].max()) for part in rows)
        was = self.last.get() if self.last.exists() else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at = max(newest, was[0]) if was else newest
        self.last.update((at, False))
        self.handle.registerTimer(at // 1000 + self.limit)
        if was and was[1] and newest > was[0]:
            yield pd.DataFrame([(key[0], newest, "back")], columns=["symbol", "at", "status"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, silent = self.last.get()
        if not silent and at // 1000 + self.limit <= timerValues.getCurrentWatermarkInMs():
            self.last.update((at, True))
            yield pd.DataFrame([(key[0], at, "silent")], columns=["symbol", "at", "status"])

    def close(self) -> None:
        pass


def silences(ticks: DataFrame, limit: str, late: str = "0 seconds", name: str = "feed") -> DataFrame:
    """(symbol, at, status): symbols whose last row, ``at`` in microseconds, is ``limit`` behind the stream, and when they return.

    The timers of a symbol fire by the watermark that all symbols move, so it needs no further row of its own.
    Each batch's progress also holds the observed metrics ``rows``, ``newest`` and ``lag_ms`` (wall clock) under ``name``.
    """
    spark = prepared(ticks.sparkSession)
    ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {limit}) AS n").first().n
    newest = F.max(F.unix_millis("ts"))
    seen = ticks.observe(name, F.count("*").alias("rows"), newest.alias("newest"), F.min(F.unix_millis(F.current_timestamp()) - F.unix_millis("ts")).alias("lag_ms"))
    keyed = seen.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"))
    return keyed.groupBy("symbol").transformWithStateInPandas(Silence(ms), "symbol string, at long, status string", "append", "EventTime")


#: Groups of contents that are kept together; a checkpoint holds for one number of them.
BUCKETS = 1024


class Seen(InOrder):
    """Hands on a document unless one of the same content was seen within ``ttl_ms``; each sight counts anew.

    A key is a bucket of many contents, so that state and timers are asked once a bucket and not once a document.
    """

    def __init__(self, ttl_ms: int, texts: bool = True) -> None:
        self.ttl = ttl_ms
        more = ["text"] if texts else []
        self.held_fields, self.out_columns = [f"{c} string" for c in ["hash", "path", *more]], ["hash", "at", "path", *more]

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "hash string, at long")

    def keep(self, last: dict[str, int], until: int) -> None:
        """Keeps what a row from ``until`` (microseconds) on can still meet, and asks for a timer for when none can."""
        rows = [(h, at) for h, at in last.items() if at + self.ttl * 1000 >= until]
        self.last.clear()
        if rows:
            self.last.put(rows)
            self.handle.registerTimer(max(at for _, at in rows) // 1000 + self.ttl + 1)

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        last = {r[0]: r[1] for r in self.last.get()}
        out = []
        for at, _, content, *rest in rows:
            before = last.get(content)
            if before is None or at - before > self.ttl * 1000:
                out.append((content, at, *rest))
            last[content] = at
        self.keep(last, rows[-1][0])
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        # hashes go once nothing can meet them any more
        newest = max((r[1] for r in self.last.get()), default=None)
        if newest is not None and newest // 1000 + self.ttl < timerValues.getCurrentWatermarkInMs():
            first = min((r[0] for r in self.held.get()), default=None)
            if first is None or first - newest > self.ttl * 1000:
                self.last.clear()


def unseen(docs: DataFrame, ttl: str, late: str = "0 seconds", texts: bool = True) -> DataFrame:
    """(hash, at, path, text) of a stream (path, ts timestamp, text) without copies of what came up to ``ttl`` before, whatever its path.

    Null texts and paths are left out.  Without ``texts`` the texts are neither held nor handed on, only their hashes.
    """
    spark = prepared(docs.sparkSession)
    ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS n").first().n
    known = docs.filter("path IS NOT NULL AND text IS NOT NULL").withWatermark("ts", late)
    more = ["text"] if texts else []
    keyed = known.select(F.sha2("text", 256).alias("hash"), "ts", F.unix_micros("ts").alias("at"), F.lit(0).alias("rank"), "path", *more)
    schema = ", ".join(["hash string, at long, path string", *[f"{c} string" for c in more]])
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(Seen(ms, texts), schema, "append", "EventTime")


class Online(InOrder):
    """The features of ``operators.materialized`` bar by bar, from the state of a batch table on."""

    held_fields = ["high double", "low double", "close double"]
    out_columns = ["symbol", "at", "close", "ema10", "ema20", "rsi", "atr"]

    def __init__(self, n: int) -> None:
        self.n = n

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "n long, close double, ema10 double, ema20 double, up double, down double, atr double")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState[["n", "close", "ema10", "ema20", "up", "down", "atr"]].iloc[-1]
        self.kept.update((int(row["n"]), *[float(v) for v in row.iloc[1:]]))

    def averaged(self, was: float, x: float, i: int, first: int, last: int) -> float:
        """Wilder's average at row ``i``, seeded with the mean of rows ``first`` to ``last``."""
        if i < first:
            return 0.0
        if i <= last:
            total = (was if i > first else 0.0) + x
            return total / (last - first + 1) if i == last else total
        return was + (x - was) / self.n

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        i, last, fast, slow, up, down, atr = self.kept.get() if self.kept.exists() else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for at, _, high, low, close in rows:
            move = 0.0 if last is None else close - last
            span = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
            fast, slow = (close, close) if i == 0 else (fast + 2 / 11 * (close - fast), slow + 2 / 21 * (close - slow))
            up, down = (self.averaged(was, x, i, 1, self.n) for was, x in ((up, max(move, 0.0)), (down, max(-move, 0.0))))
            atr = self.averaged(atr, span, i, 0, self.n - 1)
            rsi = None if i < self.n else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            out.append((key[0], at, close, fast, slow, rsi, atr if i >= self.n - 1 else None))
            i, last = i + 1, close
        self.kept.update((i, last, fast, slow, up, down, atr))
        return out


def online(bars: DataFrame, warm: DataFrame | None = None, late: str = "0 seconds", n: int = 14) -> DataFrame:
    """(symbol, at, close, ema10, ema20, rsi, atr) of a stream (symbol, ts timestamp, high, low, close), on from the states ``warm``."""
    prepared(bars.sparkSession)
    keyed = bars.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), F.lit(0).alias("rank"), "high", "low", "close")
    schema = "symbol string, at long, close double, ema10 double, ema20 double, rsi double, atr double"
    return keyed.groupBy("symbol").transformWithStateInPandas(Online(n), schema, "append", "EventTime", None if warm is None else warm.groupBy("symbol"))
