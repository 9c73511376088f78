"""Bars from ticks: derivation, resampling, cleaning, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, size, seq) from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"), F.col("o_orderkey").alias("seq"))


def bars(t: DataFrame, every: str) -> DataFrame:
    """Left-closed OHLCV bars; open and close by (ts, seq); no bar without a tick."""
    at = F.struct("ts", "seq")
    out = t.groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def bars_of(spark: SparkSession, sf_dir: str, every: str = "4 hours") -> DataFrame:
    return bars(ticks(spark, sf_dir), every)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(order_ticks(spark, sf_dir), "1 day")


def resample(b: DataFrame, every: str) -> DataFrame:
    """Coarser bars from finer ones."""
    out = b.groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def resample_count(b: DataFrame, factor: int) -> DataFrame:
    """Every ``factor`` bars of a symbol as one; a trailing part is dropped."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    out = b.withColumn("g", F.floor((n - 1) / factor)).groupBy("symbol", "g").agg(F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"))
    return out.filter(F.col("n") == factor).drop("g", "n")


def clean(b: DataFrame) -> DataFrame:
    """Rows with all four prices, each above zero."""
    return b.filter(" AND ".join(f"{c} > 0" for c in ("open", "high", "low", "close")))


def keep_one(b: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return b.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def validate(b: DataFrame) -> DataFrame:
    """Fails at run time on a bar without all four prices above zero."""
    good = F.expr("open > 0 AND high > 0 AND low > 0 AND close > 0")
    return b.withColumn("close", F.when(good, F.col("close")).otherwise(F.raise_error(F.lit("bar without valid prices")).cast("double")))


def numbered(df: DataFrame, keys: list[str], order: list, bucket, name: str = "k") -> DataFrame:
    """``df`` with the number, from 1, of each row among those of its ``keys`` in ``order``.

    ``bucket``, a Column that never falls along ``order``, cuts the work: rows are counted by key and
    bucket, the counts summed up, and only the rows of a bucket are numbered by one task.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.withColumn("_own", own).join(first, [*keys, "_bucket"]).withColumn(name, F.col("_first") + F.col("_own")).drop("_bucket", "_own", "_first")


def defaulted(b: DataFrame) -> DataFrame:
    """Bars with all columns: missing or null opens, highs and lows are the close, a missing volume has no bound."""
    for c in ("open", "high", "low"):
        b = b.withColumn(c, F.coalesce(c, "close") if c in b.columns else F.col("close"))
    return b.withColumn("volume", F.coalesce("volume", F.lit(float("inf"))) if "volume" in b.columns else F.lit(float("inf")))


def keep_n(b: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return b.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
