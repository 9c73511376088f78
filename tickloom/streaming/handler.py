"""What is done with each bar of a stream: its side, and where that changes an order, its fill, and a row of a journal.

The features of a stream come in order by symbol and batch.  The position of each
symbol is a row of a versioned table, the journal is another.  Both are merged by
the number of the batch, the journal first: a batch that is run again after a
failure between the two finds the positions from before it, makes the same rows,
and changes the journal no more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.sources import versioned

JOURNAL = "symbol string, at long, action string, intent string, shares long, price double, commission double, pnl double"
HELD = "symbol string, side int, shares long, price double"


@dataclass(frozen=True)
class Rules:
    """Capital of a symbol and the share of it that a position takes; costs as fractions; the band of the averages without a side."""

    capital: float = 100_000.0
    share: float = 0.1
    slippage: float = 0.0005
    commission: float = 0.001
    band: float = 0.0001


def side(rules: Rules) -> Column:
    """Of the fast over the slow average; none within the band; null until the features are warm."""
    gap, width = F.col("ema10") - F.col("ema20"), F.lit(rules.band) * F.col("close")
    return F.when(F.col("rsi").isNotNull(), F.when(gap > width, 1).when(gap < -width, -1).otherwise(0))


def orders(features: DataFrame, held: DataFrame, rules: Rules) -> DataFrame:
    """The journal's rows of ``features`` (symbol, at, close, ema10, ema20, rsi), after the positions ``held``, with the position then (side, held_shares).

    An order closes what was held and opens what the new side takes, at the close and the slippage
    against it.  A row whose position would be of no share is of side 0.
    """
    w = Window.partitionBy("symbol").orderBy("at")
    size = F.floor(F.lit(rules.capital * rules.share) / F.col("close")).cast("long")
    known = features.withColumn("side", side(rules)).filter("side IS NOT NULL AND close > 0")
    known = known.withColumn("side", F.when(size > 0, F.col("side")).otherwise(0)).join(held.select("symbol", F.col("side").alias("__side"), F.col("shares").alias("__shares"), F.col("price").alias("__price")), "symbol", "left")
    changed = known.withColumn("was", F.coalesce(F.lag("side").over(w), "__side", F.lit(0))).filter("side <> was")
    price = F.col("close") * (1 + F.lit(rules.slippage) * F.signum(F.col("side") - F.col("was")))
    filled = changed.withColumns({"price": price, "held_shares": F.when(F.col("side") == 0, 0).otherwise(size).cast("long")})
    filled = filled.withColumns({"before": F.coalesce(F.lag("held_shares").over(w), "__shares", F.lit(0)), "paid": F.coalesce(F.lag("price").over(w), "__price", F.lit(0.0))})
    shares = F.col("before") + F.col("held_shares")
    return filled.select(
        "symbol",
        "at",
        F.when(F.col("side") > F.col("was"), "buy").otherwise("sell").alias("action"),
        F.when(F.col("side") == 0, "close").when(F.col("was") == 0, "open").otherwise("reverse").alias("intent"),
        shares.alias("shares"),
        "price",
        (shares * F.col("price") * F.lit(rules.commission)).alias("commission"),
        (F.col("was") * F.col("before") * (F.col("price") - F.col("paid"))).alias("pnl"),
        "side",
        "held_shares",
    )


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A versioned table, empty where there is none yet."""
    return versioned.read(spark, path) if versioned.history(spark, path) else spark.createDataFrame([], schema)


def handle(batch: DataFrame, number: int, path: str, rules: Rules) -> None:
    """One batch of features into the journal and the positions below ``path``."""
    spark = batch.sparkSession
    new = orders(batch, table(spark, f"{path}/held", HELD), rules).persist()
    try:
        versioned.merge(new.drop("side", "held_shares"), f"{path}/journal", ["symbol", "at"], f"bars:{number}")
        last = new.groupBy("symbol").agg(F.max_by(F.struct("side", F.col("held_shares").alias("shares"), "price"), "at").alias("p"))
        versioned.merge(last.select("symbol", "p.*"), f"{path}/held", ["symbol"], f"bars:{number}")
    finally:
        new.unpersist()


def run(features: DataFrame, path: str, checkpoint: str, rules: Rules | None = None) -> None:
    """All that a stream of features has now, batch by batch."""

    def put(batch: DataFrame, number: int) -> None:
        handle(batch, number, path, rules or Rules())

    features.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
