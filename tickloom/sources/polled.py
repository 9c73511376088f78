"""Python data sources: bars that a stream polls, and binary bar files that are read by range.

``polled_bars`` is a streaming source over a folder of Parquet bars that others
add to: each poll takes the rows of each symbol after the last ones taken, and
the position is the stream's own offset, so a restart goes on where it was.
``pruned_bars`` is a batch source over the fixed-width binary files of
``files.to_binary``: filters on time skip files by their header, and the rows of
a range are found by binary search and read alone.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def _micros(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return column.cast(pa.timestamp("us")).cast(pa.int64())


class _Span(InputPartition):
    def __init__(self, symbol: str, after: int, until: int) -> None:
        self.symbol, self.after, self.until = symbol, after, until


class _BarPoll(DataSourceStreamReader):
    """Offsets are {symbol: last time taken in microseconds}."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if not os.path.isdir(self.path) or not any(f.endswith(".parquet") for f in os.listdir(self.path)):
            return {}
        # the newest time of each symbol, of which there are few; columns besides these two are not read
        rows = ds.dataset(self.path, format="parquet", exclude_invalid_files=True)
        last: dict[str, int] = {}
        for batch in rows.to_batches(columns=["symbol", "ts"]):
            table = pa.table({"symbol": batch.column(0), "ts": _micros(pa.chunked_array([batch.column(1)]))})
            for r in table.group_by("symbol").aggregate([("ts", "max")]).to_pylist():
                last[r["symbol"]] = max(last.get(r["symbol"], r["ts_max"]), r["ts_max"])
        return dict(sorted(last.items()))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Span(s, start.get(s, -(2**62)), until) for s, until in end.items() if until > start.get(s, -(2**62))]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        rows = ds.dataset(self.path, format="parquet", exclude_invalid_files=True)
        for batch in rows.to_batches(columns=_COLUMNS, filter=ds.field("symbol") == partition.symbol):
            at = _micros(pa.chunked_array([batch.column(1)])).combine_chunks()
            on = batch.filter(pc.and_(pc.greater(at, partition.after), pc.less_equal(at, partition.until)))
            if on.num_rows:
                yield on

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the offset log of the stream is the memory."""


class PolledBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_bars"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BarPoll(self.options["path"])


#: Header of a binary bar file: magic, rows, first and last time; a row: time and five numbers.
MAGIC = b"TLB1"
HEADER = "<4sqqq"
HEADER_SIZE = struct.calcsize(HEADER)
ROW = np.dtype([("ts", "<i8"), ("open", "<f8"), ("high", "<f8"), ("low", "<f8"), ("close", "<f8"), ("volume", "<f8")])


def write_ranges(bars: DataFrame, path: str) -> None:
    """One binary file for each symbol and month, in order of time, below ``path``, a folder that all executors share."""

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        rows = np.zeros(len(pdf), ROW)
        rows["ts"] = pdf["ts"].astype("datetime64[us]").astype("int64")
        for c in _COLUMNS[2:]:
            rows[c] = pdf[c]
        folder = os.path.join(path, f"symbol={pdf['symbol'].iloc[0]}")
        os.makedirs(folder, exist_ok=True)
        at = os.path.join(folder, f"{pdf['month'].iloc[0]}.bin")
        # whole under its own name, or not there
        with open(f"{at}.part", "wb") as f:
            f.write(struct.pack(HEADER, MAGIC, len(rows), int(rows["ts"][0]), int(rows["ts"][-1])))
            f.write(rows.tobytes())
        os.replace(f"{at}.part", at)
        return pd.DataFrame({"n": [len(rows)]})

    bars.select(*_COLUMNS, F.date_format("ts", "yyyy-MM").alias("month")).groupBy("symbol", "month").applyInPandas(put, "n long").agg(F.sum("n")).first()


def _bound(f, n: int, at: int, right: bool) -> int:
    """The first of ``n`` rows at or after a time, or after it: a binary search that reads eight bytes a step."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        f.seek(HEADER_SIZE + mid * ROW.itemsize)
        (ts,) = struct.unpack("<q", f.read(8))
        if ts < at or (right and ts == at):
            low = mid + 1
        else:
            high = mid
    return low


class _File(InputPartition):
    def __init__(self, at: str) -> None:
        self.at = at


class _RangeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.first, self.last, self.symbol = path, -(2**62), 2**62, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on ``ts`` and one symbol; hands everything else back."""
        for f in filters:
            taken = False
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("ts",):
                at, taken = int(np.datetime64(f.value, "us").astype("int64")), True
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, at + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, at - isinstance(f, LessThan))
            elif isinstance(f, EqualTo) and f.attribute == ("symbol",) and self.symbol in (None, f.value):
                self.symbol, taken = f.value, True
            if not taken:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for folder in sorted(os.listdir(self.path)):
            if self.symbol is not None and folder != f"symbol={self.symbol}":
                continue
            for name in sorted(os.listdir(os.path.join(self.path, folder))):
                if name.endswith(".bin"):
                    found.append(_File(os.path.join(self.path, folder, name)))
        return found

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.at, "rb", buffering=0) as f:
            magic, n, first, last = struct.unpack(HEADER, f.read(HEADER_SIZE))
            if magic != MAGIC:
                raise ValueError(f"{partition.at} is no bar file")
            if last < self.first or first > self.last:
                return
            i, j = _bound(f, n, self.first, False), _bound(f, n, self.last, True)
            f.seek(HEADER_SIZE + i * ROW.itemsize)
            symbol = os.path.basename(os.path.dirname(partition.at)).split("=", 1)[1]
            while i < j:
                some = min(j - i, 1 << 14)
                raw = b""
                while len(raw) < some * ROW.itemsize:
                    part = f.read(some * ROW.itemsize - len(raw))
                    if not part:
                        raise ValueError(f"{partition.at} ends early")
                    raw += part
                rows = np.frombuffer(raw, ROW)
                i += some
                arrays = [pa.array([symbol] * some), pa.array(rows["ts"]).cast(pa.timestamp("us")), *[pa.array(np.ascontiguousarray(rows[c])) for c in _COLUMNS[2:]]]
                yield pa.RecordBatch.from_arrays(arrays, _COLUMNS)


class PrunedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pruned_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Makes both sources known to the session; filters reach Python sources only where this is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PolledBars)
    spark.dataSource.register(PrunedBars)
    return spark
