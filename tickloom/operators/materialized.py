"""Features kept by period with the end state of each recurrence, so that a refresh goes on from where it was.

Below a path lie ``features/period=<first day>`` and ``states/period=<first day>``
(symbol, n, close, and a value for each recurrence at the symbol's last row of the
period).  A refresh reads the bars of the last period on, which may have grown,
and of later ones; it starts from the states before it and writes these periods
anew.  A stream may start from the states, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import affine

#: The recurrences that are kept.
KEPT = ["ema10", "ema20", "up", "down", "atr"]
N = 14


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def states(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """(symbol, n, close, recurrences): the last state of each symbol, of the periods before one if that is named."""
    schema = ", ".join(["symbol string, n long, close double", *[f"{k} double" for k in KEPT], "period string"])
    if not _there(spark, f"{path}/states"):
        return spark.createDataFrame([], schema).drop("period")
    rows = spark.read.schema(schema).parquet(f"{path}/states")
    rows = rows if before is None else rows.filter(F.col("period") < before)
    last = F.max_by(F.struct("n", "close", *KEPT), "period").alias("s")
    return rows.groupBy("symbol").agg(last).select("symbol", "s.*")


def last_period(spark: SparkSession, path: str) -> str | None:
    if not _there(spark, f"{path}/states"):
        return None
    return spark.read.schema("symbol string, period string").parquet(f"{path}/states").agg(F.max("period")).first()[0]


def computed(bars: DataFrame, start: DataFrame | None = None, per_block: int = affine.PER_BLOCK) -> DataFrame:
    """``bars`` with ``i``, the recurrences, and ``rsi``, from the states ``start`` (symbol, n, close, recurrences) on."""
    rows = affine.with_tail(affine.numbered(bars, per_block, start), 1, per_block)
    before = F.lag("close").over(affine.in_block())
    if start is None:
        rows = rows.withColumn("__before", before)
    else:
        rows = rows.withColumn("__lag", before).join(start.select("symbol", F.col("close").alias("__last")), "symbol", "left").withColumn("__before", F.coalesce("__lag", "__last")).drop("__lag", "__last")
    rows = rows.filter("NOT tail")
    c = F.col("close")
    step = F.coalesce(c - F.col("__before"), F.lit(0.0))
    maps = {
        "ema10": affine.ema(c, 10),
        "ema20": affine.ema(c, 20),
        "up": affine.wilder(F.greatest(step, F.lit(0.0)), N, 1, N),
        "down": affine.wilder(F.greatest(-step, F.lit(0.0)), N, 1, N),
        "atr": affine.wilder(affine.true_range(F.col("__before")), N, 0, N - 1),
    }
    out = affine.solved(rows, maps, None if start is None else start.select("symbol", *KEPT), per_block)
    return out.withColumn("rsi", affine.masked(affine.strength(F.col("up"), F.col("down")), N))


def refresh(bars: DataFrame, path: str, period: str = "month", per_block: int = affine.PER_BLOCK) -> str | None:
    """Computes what is new of ``bars`` (symbol, ts, open, high, low, close); returns the period that it began with, None for all."""
    spark = bars.sparkSession
    since = last_period(spark, path)
    start = None
    if since is not None:
        bars, start = bars.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")), states(spark, path, since)
    rows = computed(bars, start, per_block).withColumn("period", F.date_format(F.date_trunc(period, "ts"), "yyyy-MM-dd"))
    features = rows.select("symbol", "ts", "close", "ema10", "ema20", "rsi", affine.masked(F.col("atr"), N - 1).alias("atr"), "period", "i", "up", "down", F.col("atr").alias("__atr"))
    at = f"{path}/features"
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(at)
    done = spark.read.schema(features.select(*[c for c in features.columns if c != "period"]).schema.add("period", "string")).parquet(at)
    done = done if since is None else done.filter(F.col("period") >= since)
    end = F.max_by(F.struct((F.col("i") + 1).alias("n"), "close", "ema10", "ema20", "up", "down", F.col("__atr").alias("atr")), "i").alias("s")
    done.groupBy("symbol", "period").agg(end).select("symbol", "s.*", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{path}/states")
    return since


def features(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ts, close, ema10, ema20, rsi, atr), null until warmed up."""
    return spark.read.parquet(f"{path}/features").select("symbol", "ts", "close", "ema10", "ema20", "rsi", "atr")
