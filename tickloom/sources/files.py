"""Bars in files: fixed binary records, Arrow IPC, CSV and tables of a database.

Binary and Arrow files are read whole by one task each, so a file should hold one
symbol (or one symbol and period), as Parquet does for everything larger.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the record format: magic, version, reserved, rows, first and last time; then one record a bar.
MAGIC = b"QFM\0"
HEADER = "<4sHHqqq"
RECORD = np.dtype([("date", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("volume", "<f4")])

PRICES = ["open", "high", "low", "close", "volume"]
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
PACKED = "symbol string, content binary"


def _packed(bars: DataFrame, pack) -> DataFrame:
    """One row per symbol: (symbol, content), the bars in order of time."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"symbol": [key[0].as_py()], "content": [pack(group.take(np.argsort(group["ts"].cast(pa.int64()).to_numpy(), kind="stable")))]}, pa.schema([("symbol", pa.string()), ("content", pa.binary())]))

    return bars.select("symbol", "ts", *PRICES).groupBy("symbol").applyInArrow(run, PACKED)


def to_binary(bars: DataFrame) -> DataFrame:
    """Bars as the bytes of one file of records per symbol; prices become 32-bit floats."""

    def pack(group: pa.Table) -> bytes:
        rec = np.zeros(group.num_rows, RECORD)
        rec["date"] = group["ts"].cast(pa.timestamp("ns")).cast(pa.int64()).to_numpy()
        for c in PRICES:
            rec[c] = group[c].to_numpy()
        ends = (int(rec["date"][0]), int(rec["date"][-1])) if len(rec) else (0, 0)
        return struct.pack(HEADER, MAGIC, 1, 0, len(rec), *ends) + rec.tobytes()

    return _packed(bars, pack)


def to_arrow(bars: DataFrame) -> DataFrame:
    """Bars as the bytes of one Arrow IPC file per symbol."""

    def pack(group: pa.Table) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, group.drop_columns("symbol").schema) as f:
            f.write_table(group.drop_columns("symbol"))
        return out.getvalue().to_pybytes()

    return _packed(bars, pack)


def _unpacked(files: DataFrame, unpack) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = unpack(content)
                cols = [pa.array([symbol] * t.num_rows, pa.string()), t["ts"].cast(pa.timestamp("us")).combine_chunks()]
                yield pa.RecordBatch.from_arrays([*cols, *(t[c].cast(pa.float64()).combine_chunks() for c in PRICES)], ["symbol", "ts", *PRICES])

    return files.select("symbol", "content").mapInArrow(run, BARS)


def from_binary(files: DataFrame) -> DataFrame:
    """Bars of (symbol, content) with files of records; a file with another magic fails the job."""

    def unpack(content: bytes) -> pa.Table:
        magic, _, _, n, _, _ = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("not a file of bar records")
        rec = np.frombuffer(content, RECORD, n, struct.calcsize(HEADER))
        return pa.table({"ts": pa.array(rec["date"], pa.timestamp("ns"))} | {c: pa.array(np.ascontiguousarray(rec[c])) for c in PRICES})

    return _unpacked(files, unpack)


def from_arrow(files: DataFrame) -> DataFrame:
    """Bars of (symbol, content) with Arrow IPC files; what follows the closing mark of a file is passed over."""
    end = b"ARROW1"
    return _unpacked(files, lambda content: pa.ipc.open_file(content[: content.rindex(end) + len(end)]).read_all())


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    dot = ending.replace(".", r"\.")
    named = found.select(F.regexp_extract("path", rf"([^/=]*){dot}(/[^/]*)?$", 1).alias("symbol"), "content")
    return named.filter("symbol <> ''")


def between(bars: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; empty means unbounded."""
    for sign, at in ((">=", start), ("<=", end)):
        bars = bars.filter(f"ts {sign} timestamp_ntz'{at}'") if at else bars
    return bars


def read_binary(spark: SparkSession, path: str, start: str = "", end: str = "") -> DataFrame:
    """Bars of all ``<symbol>.bin`` files, or files in folders ``file=<symbol>.bin``, below ``path``."""
    return between(from_binary(_files(spark, path, ".bin")), start, end)


def read_arrow(spark: SparkSession, path: str, start: str = "", end: str = "") -> DataFrame:
    """Bars of all ``<symbol>.arrow`` files, or files in folders ``file=<symbol>.arrow``, below ``path``."""
    return between(from_arrow(_files(spark, path, ".arrow")), start, end)


def write_files(packed: DataFrame, path: str, ending: str, replace: bool = False) -> None:
    """One file for each row of (symbol, content), below ``path``, in a folder ``file=<symbol><ending>``.

    Spark's text writer puts a line end behind the bytes, which either format passes over.  With
    ``replace`` the files of the symbols in ``packed`` are replaced and others kept; else ``path`` must be new.
    """
    if ending not in (".bin", ".arrow"):
        raise ValueError(f"no file kind {ending!r}")
    lines = packed.select(F.col("content").cast("string").alias("value"), F.concat("symbol", F.lit(ending)).alias("file"))
    out = lines.write.option("maxRecordsPerFile", 1).partitionBy("file")
    (out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else out).text(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(n, bytes, files) of a Parquet table without reading its data: rows from the footers, sizes from the listing."""
    rows = spark.read.parquet(path)
    sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    return rows.agg(F.count("*").alias("n")).join(sizes, F.lit(True))


def write_csv(bars: DataFrame, path: str) -> None:
    bars.select("symbol", "ts", *PRICES).write.mode("overwrite").csv(path, header=True)


def preload(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files whose headers may be of any case, with ``date`` for ``ts``; values that are no numbers are null, rows without a close are left out."""
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}
    ts = next(names[c] for c in ("ts", "date", "timestamp", "datetime", "time") if c in names)
    prices = [F.expr(f"try_cast(`{names[c]}` AS DOUBLE)").alias(c) for c in PRICES if c in names]
    return raw.select(F.col(names["symbol"]).alias("symbol"), F.expr(f"try_cast(`{ts}` AS TIMESTAMP_NTZ)").alias("ts"), *prices).filter("close IS NOT NULL")


def read_csv(spark: SparkSession, path: str, start: str = "", end: str = "") -> DataFrame:
    return between(spark.read.csv(path, header=True, schema=BARS), start, end)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, start: str = "", end: str = "") -> DataFrame:
    """Bars with the filter on time pushed down; of ``columns`` those that the file has."""
    bars = between(spark.read.parquet(path), start, end)
    return bars.select(*[c for c in columns if c in bars.columns]) if columns else bars


def read_database(spark: SparkSession, url: str, table: str, symbol: str, start: str = "", end: str = "", **options: str) -> DataFrame:
    """Bars of one symbol; Spark pushes the predicates into the database."""
    bars = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return between(bars.filter(F.col("symbol") == symbol), start, end)


def write_parquet(bars: DataFrame, path: str) -> None:
    """One folder per symbol; only the symbols in ``bars`` are replaced."""
    bars.repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


#: Tiers of a save, in the order in which a reader looks for them.
TIERS = ("arrow", "binary", "parquet")


def write_tiers(bars: DataFrame, path: str, tiers: tuple[str, ...] = TIERS) -> None:
    """Bars in each of ``tiers`` below ``path``, from one computation of them; the files of symbols not in ``bars`` are kept.

    Prices of the binary tier are 32-bit floats.
    """
    unknown = set(tiers) - set(TIERS)
    if unknown:
        raise ValueError(f"no tiers {sorted(unknown)}")
    kept = bars.select("symbol", "ts", *PRICES).persist()
    try:
        for tier in tiers:
            if tier == "parquet":
                write_parquet(kept, f"{path}/{tier}")
            else:
                pack, ending = (to_arrow, ".arrow") if tier == "arrow" else (to_binary, ".bin")
                write_files(pack(kept), f"{path}/{tier}", ending, True)
    finally:
        kept.unpersist()


def read_tier(spark: SparkSession, path: str, tier: str | None = None, start: str = "", end: str = "") -> DataFrame:
    """Bars of a tier of ``write_tiers``; of the first that is there where none is named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [t for t in TIERS if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{t}"))]
    if (tier or "") not in ("", *there) or not there:
        raise ValueError(f"no tier {tier or ''} below {path}")
    read = {"arrow": read_arrow, "binary": read_binary, "parquet": lambda *a: read_parquet(spark, a[1], ["symbol", "ts", *PRICES], *a[2:])}[tier or there[0]]
    return read(spark, f"{path}/{tier or there[0]}", start, end).select("symbol", "ts", *PRICES)
