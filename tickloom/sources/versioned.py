"""Tables that are merged into: buckets written anew where a merge touches them, and a log of versions.

A table is a folder with ``data/<commit>/bucket=<b>`` and ``log/<version>.json``.
A version of the log names the folder of each bucket, so a merge writes the
buckets that its rows fall into, and publishes them by creating the next file of
the log, which only one writer can do.  Readers see a version whole or not at
all, and older ones stay readable.  The log keeps the names of the batches that
made it: a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shuffles import setting

#: Buckets of a table: what a merge writes at least is one of them.
BUCKETS = 32
#: Keys that are sent to all tasks, at most.
FEW = 1_000_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def history(spark: SparkSession, path: str) -> list[dict]:
    """The versions of a table, oldest first: version, batch, keys, schema, and the folder of each bucket."""
    at, fs = _fs(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    # a file that a writer has only begun has no line yet
    found = spark.read.text(f"{path}/log", wholetext=True).collect()  # a row a version
    return sorted((json.loads(r.value) for r in found if r.value), key=lambda x: x["version"])


def _publish(spark: SparkSession, path: str, entry: dict) -> bool:
    """Makes ``entry`` the next version, unless another writer has: the file is written aside and then given its name."""
    at, fs = _fs(spark, f"{path}/log/{entry['version']:08}.json")
    aside, _ = _fs(spark, f"{path}/aside/{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps(entry).encode())
    out.close()
    fs.mkdirs(at.getParent())
    try:
        done = not fs.exists(at) and fs.rename(aside, at)
    except Py4JJavaError:
        done = False
    if not done:
        fs.delete(aside, False)
    return done


def bucket(keys: list[str]):
    """The bucket that a row is in by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def merge(rows: DataFrame, path: str, keys: list[str], batch: str, deleted: str | None = None, given: DataFrame | None = None) -> int:
    """The version after all rows whose ``keys`` ``rows`` has are replaced by those that it has; keys are compared null-safely.

    Where the boolean column ``deleted`` is set a row only removes.  Returns the version that holds
    the batch, which is an older one if the batch was there.  With ``given``, the keys of ``rows``, ``rows`` is
    read once; it is then together by ``bucket(keys)`` as it comes, and so not shuffled.
    """
    spark = rows.sparkSession
    flagged = rows.withColumn("__gone", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False))
    flagged = (flagged.drop(deleted) if deleted else flagged).withColumn("bucket", bucket(keys))
    columns = [c for c in rows.columns if c != deleted]
    while True:
        log = history(spark, path)
        known = [x for x in log if x["batch"] == batch]
        if known:
            return known[0]["version"]
        now = log[-1] if log else {"version": 0, "folders": {}, "keys": keys}
        if now["keys"] != keys:
            raise ValueError(f"the table has the keys {now['keys']}")
        commit = f"data/{uuid.uuid4().hex}"
        named = flagged.select("bucket", *keys) if given is None else given.select(bucket(keys).alias("bucket"), *keys)
        touched = sorted(r.bucket for r in named.select("bucket").distinct().collect())  # BUCKETS at most
        new = flagged.filter("NOT __gone").select(*columns, "bucket")
        old = _read(spark, path, now, [str(b) for b in touched])
        if old is not None:
            gone = named.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            # where the keys are few enough to be sent to all, what stays is written as it lies in its bucket
            few = given is not None and gone.limit(FEW + 1).count() <= FEW
            stay = old.join(F.broadcast(gone) if few else gone, same, "left_anti").withColumn("bucket", bucket(keys))
            new = new.unionByName(stay if few or given is None else stay.repartition("bucket"), allowMissingColumns=True)
        new = new.repartition("bucket") if given is None else new
        with setting(spark, CLEANUP="true", ALL_KEYS="false"):
            new.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{commit}")
        folders = dict(now["folders"])
        at, fs = _fs(spark, f"{path}/{commit}")
        held = {s.getPath().getName() for s in fs.listStatus(at)}
        for b in touched:
            folders.pop(str(b), None)
            if f"bucket={b}" in held:
                folders[str(b)] = f"{commit}/bucket={b}"
        schema = new.drop("bucket").schema.simpleString()[len("struct<") : -1]
        entry = {"version": now["version"] + 1, "batch": batch, "keys": keys, "schema": schema, "folders": folders}
        if _publish(spark, path, entry):
            return entry["version"]


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes what only older versions than the last one hold; they can't be read any more, and their batches stay known."""
    log = history(spark, path)
    kept = set(log[-1]["folders"].values()) if log else set()
    for folder in {f for x in log for f in x["folders"].values()} - kept:
        at, fs = _fs(spark, f"{path}/{folder}")
        fs.delete(at, True)


def _read(spark: SparkSession, path: str, entry: dict, buckets: list[str] | None = None) -> DataFrame | None:
    folders = [f for b, f in entry["folders"].items() if buckets is None or b in buckets]
    if not folders:
        return None
    schema = ", ".join(f"`{n}` {t}" for n, t in (x.split(":", 1) for x in _fields(entry["schema"])))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _fields(schema: str) -> list[str]:
    """The fields of a struct's text, cut at the commas between them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    log = history(spark, path)
    found = [x for x in log if version is None or x["version"] == version]
    if not found:
        raise ValueError(f"no version {version} of {path}")
    rows = _read(spark, path, found[-1])
    if rows is None:
        schema = ", ".join(f"`{n}` {t}" for n, t in (x.split(":", 1) for x in _fields(found[-1]["schema"])))
        return spark.createDataFrame([], schema)
    return rows


def differences(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """(key columns, change): rows 'added', 'removed' or 'changed' between two versions; buckets that both share are not read."""
    log = {x["version"]: x for x in history(spark, path)}
    a, b = log[before], log[after]
    apart = [k for k in {*a["folders"], *b["folders"]} if a["folders"].get(k) != b["folders"].get(k)]
    keys = b["keys"]
    empty = spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in (x.split(":", 1) for x in _fields(b["schema"]))))
    sides = []
    for entry, name in ((a, "was"), (b, "now")):
        rows = _read(spark, path, entry, apart)
        rows = empty if rows is None else rows
        every = F.sort_array(F.collect_list(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))
        sides.append(rows.groupBy(*keys).agg(every.alias(name)))
    both = sides[0].join(sides[1].withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(*[F.when(F.col("now").isNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys], change.alias("change")).filter("change IS NOT NULL")


def sink(path: str, keys: list[str], name: str):
    """For ``foreachBatch``: merges each batch once, however often it is run; of a key the rows of one batch stay together."""

    def put(batch: DataFrame, number: int) -> None:
        merge(batch, path, keys, f"{name}:{number}")

    return put
