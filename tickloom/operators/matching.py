"""One-to-one matching of two sides by key and time, within a tolerance.

In order of time the earliest open row of one side is matched with the earliest
of the other that is within the tolerance; a row that the other side has left
behind stays without a partner.  Nothing matches across a pause of the key that
is longer than the tolerance, so a key falls into clusters that are matched apart
from each other; the pauses are found from the first and last time of each cell
of the tolerance's width.  A task holds the open rows of one cluster only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clustered(rows: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """``rows`` (keys, at) with ``cluster``: a new one where a key pauses for longer than the tolerance."""
    width = max(1, tolerance)
    cell = F.floor((F.col("at") - F.pmod("at", F.lit(width))) / width)
    celled = rows.withColumn("__cell", cell)
    sums = celled.groupBy(*keys, "__cell").agg(F.min("at").alias("__lo"), F.max("at").alias("__hi"))
    w = Window.partitionBy(*keys).orderBy("__cell")
    new = F.when(F.col("__lo") - F.lag("__hi").over(w) <= tolerance, 0).otherwise(1)
    named = sums.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__cell").alias("__of"), "cluster")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return celled.join(named, [*same, F.col("__cell") == F.col("__of")]).drop("__cell", "__of", *[f"__{k}" for k in keys])


def matched(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """(left_id, right_id, delay) of (id, keys, at): pairs, and rows without a partner with a null for it.

    ``at`` and the tolerance are whole numbers of one unit; rows of equal time go by id.  Rows without a time have no partner.
    """
    sides = [x.select("id", *keys, F.col("at").cast("long"), F.lit(k).alias("side")) for k, x in enumerate((left, right))]
    every = sides[0].unionByName(sides[1])
    timed = clustered(every.filter("at IS NOT NULL"), keys, tolerance)
    timed = timed.withColumn("__group", F.xxhash64(*keys, "cluster"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, (deque(), deque())
        out: list[tuple] = []

        def alone(until: int | None) -> None:
            for side, held in enumerate(open_):
                while held and (until is None or held[0][0] < until):
                    _, i = held.popleft()
                    out.append((i, None, None) if side == 0 else (None, i, None))

        for pdf in batches:
            for *group, at, i, side in pdf.itertuples(index=False, name=None):
                group = tuple(None if pd.isna(g) else g for g in group)
                if group != now:
                    alone(None)
                    now = group
                alone(at - tolerance)
                if open_[1 - side]:
                    was, other = open_[1 - side].popleft()
                    out.append((i, other, was - at) if side == 0 else (other, i, at - was))
                else:
                    open_[side].append((at, i))
            yield pd.DataFrame(out, columns=["left_id", "right_id", "delay"]).astype("Int64")
            out.clear()
        alone(None)
        yield pd.DataFrame(out, columns=["left_id", "right_id", "delay"]).astype("Int64")

    # equal hashes of two groups would only be next to each other, as the keys themselves tell groups apart
    order = ["__group", *keys, "cluster", "at", "id", "side"]
    dealt = timed.repartition("__group").sortWithinPartitions(*order).select(*keys, "cluster", "at", "id", "side")
    found = dealt.mapInPandas(run, "left_id long, right_id long, delay long")
    rest = every.filter("at IS NULL").select(F.when(F.col("side") == 0, F.col("id")).cast("long").alias("left_id"), F.when(F.col("side") == 1, F.col("id")).cast("long").alias("right_id"), F.lit(None).cast("long").alias("delay"))
    return found.union(rest)
