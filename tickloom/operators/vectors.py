"""A stored vector index that is searched exactly: cells of a coarse quantiser, skipped by the triangle bound.

The index below a path has ``centres`` (cell, centre), fitted once on a bounded
sample, ``cells`` with a folder for every batch that was added (cell, vec_id,
x), ``radii`` (cell, radius) in folders alike, and ``removed``.  Vectors are of
length one, so a distance tells a cosine.  A query is scored in its own nearest
cells first; a cell farther than its radius and the distance of the k-th best so
far can hold nothing better and is not read for that query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that fit the centres at most, and cells of an index at most.
SAMPLE, CELLS = 20_000, 256
#: Vectors of a cell that meet queries in one task, about.
PER_TASK = 8192
#: Cells that give a query its first bound.
FIRST = 2
#: What the bound leaves for rounding.
SLACK = 1e-6


def unit(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors of length one; rows without an id, and null, zero or unfit vectors, are left out."""
    ok = "vec_id IS NOT NULL AND exists(embedding, v -> v <> 0) AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    x = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return vectors.filter(ok).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: v / length).alias("x"))


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS at most
    return np.array([r.centre for r in rows])


def create(vectors: DataFrame, path: str, rounds: int = 6) -> None:
    """Fits the centres, about the root of the number of vectors, and adds the vectors."""
    spark = vectors.sparkSession
    x = unit(vectors)
    n = x.count()
    some = x.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).limit(SAMPLE).toPandas().sort_values("vec_id")
    points = np.stack(some["x"].to_list()) if len(some) else np.zeros((1, 1))
    k = max(1, min(CELLS, int(n**0.5), len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        for c in range(k):
            if (near == c).any():
                centres[c] = points[near == c].mean(0)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    add(vectors, path)


def add(vectors: DataFrame, path: str) -> None:
    """Adds (vec_id, embedding); an id that is there already must be removed first."""
    spark = vectors.sparkSession
    centres = _centres(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_list())
                far = np.linalg.norm(x[:, None, :] - centres[None], axis=2) if len(x) * len(centres) < 1 << 16 else np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0))
                cell = far.argmin(1)
                yield pd.DataFrame({"cell": cell.astype("int32"), "vec_id": pdf["vec_id"], "x": pdf["x"], "far": far[np.arange(len(x)), cell]})

    batch = f"batch={uuid.uuid4().hex}"
    placed = unit(vectors).mapInPandas(run, "cell int, vec_id long, x array<double>, far double")
    placed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/cells/{batch}")
    spark.read.parquet(f"{path}/cells/{batch}").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).write.parquet(f"{path}/radii/{batch}")


def remove(ids: DataFrame, path: str) -> None:
    """Marks the vectors of (vec_id) that are there as removed; they may be added again."""
    held = cells(ids.sparkSession, path).join(ids.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi").select("vec_id", "batch")
    held.write.parquet(f"{path}/removed/at={uuid.uuid4().hex}")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell, vec_id, x, batch) of the vectors that are there."""
    rows = spark.read.schema("vec_id long, x array<double>, far double, batch string, cell int").parquet(f"{path}/cells")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/removed")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.schema("vec_id long, batch string, at string").parquet(f"{path}/removed").drop("at"), ["vec_id", "batch"], "left_anti")
    return rows.select("cell", "vec_id", "x", "batch")


def _met(asked: DataFrame, held: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, sim): up to ``k`` of each task for queries (query_id, q, cell) in the cells that they name."""
    salts = F.greatest(F.ceil(F.col("n") / PER_TASK), F.lit(1)).cast("int")
    known = sizes.select("cell", salts.alias("salts"))
    left = asked.join(known, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("cell", "salt", "query_id", "q")
    right = held.join(known, "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")).select("cell", "salt", "vec_id", "x")

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("vec_id")
            x, ids = np.stack(v["x"].to_list()), v["vec_id"].to_numpy()
            for start in range(0, len(q), 512):
                some = q.iloc[start : start + 512]
                sims = np.round(np.stack(some["q"].to_list()) @ x.T, 9)
                for query, row in zip(some["query_id"], sims, strict=True):
                    at = np.argsort(-row, kind="stable")[:k]
                    out += [(query, ids[i], row[i]) for i in at]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "sim"]).astype({"query_id": "int64", "vec_id": "int64", "sim": "float64"})

    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(score, "query_id long, vec_id long, sim double")


def search(queries: DataFrame, path: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, sim), the ``k`` of highest cosine to each query (vec_id, embedding), and (query_id, cells, read): its cells and those read.

    Nothing is lost: what is not read is too far by the triangle bound.  Equal cosines, to nine places, go by id.
    """
    spark = queries.sparkSession
    centres = _centres(spark, path)
    held = cells(spark, path)
    sizes = spark.read.schema("cell int, radius double, n long").parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    radius = np.zeros(len(centres))
    there = np.zeros(len(centres), bool)
    for r in sizes.collect():  # CELLS at most
        radius[r.cell], there[r.cell] = r.radius, True

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The least distance that each cell can have, and which cells come first."""
        for pdf in batches:
            if len(pdf):
                q = np.stack(pdf["q"].to_list())
                far = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(1)[None], 0))
                far[:, ~there] = np.inf
                order = np.argsort(far, 1)[:, :FIRST]
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order, True, 1)
                who, cell = np.nonzero(np.isfinite(far))
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[who], "cell": cell.astype("int32"), "least": np.maximum(far[who, cell] - radius[cell], 0), "first": first[who, cell]})

    asked = unit(queries).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    near = asked.mapInPandas(reach, "query_id long, cell int, least double, first boolean")
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    some = top(_met(near.filter("first").join(asked, "query_id").select("query_id", "q", "cell"), held, sizes, k))
    sure = some.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))).alias("far"))
    more = near.filter("NOT first").join(sure, "query_id", "left").filter(F.col("far").isNull() | (F.col("least") <= F.col("far") + SLACK))
    found = top(some.drop("rank").union(_met(more.join(asked, "query_id").select("query_id", "q", "cell"), held, sizes, k))).drop("rank")
    # queries without k in their first cells read all cells
    read = near.filter("first").select("query_id", "cell").union(more.select("query_id", "cell")).groupBy("query_id").agg(F.count("*").alias("read"))
    return found, read.withColumn("cells", F.lit(int(there.sum())))
