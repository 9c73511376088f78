"""What the operators share: table access, shared storage, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shuffles import setting

#: Rows in an Arrow batch: texts are long, so batches are short.
BATCH_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that this process has written below the shared folder and not removed.
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors see.

    Where the setting is absent a local master gets a local folder; a cluster gets an
    error, as its executors would write to disks of their own and the rows be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back.

    Cuts the lineage: a lost executor makes Spark reread the files, not rerun the job.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with setting(spark, CLEANUP="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by ``stored`` that nothing reads any more."""
    _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _kept:
        _kept.remove(at)


def only(build: Callable[[], DataFrame]) -> DataFrame:
    """Stores the frame that ``build`` makes and removes all that was written for it meanwhile."""
    before = set(_kept)
    out = stored(build())
    for at in [x for x in _kept if x not in before and x != out.stored_at]:
        _remove(out.sparkSession, at)
    return out


#: What tells one row of documents from another: its id and its whole text.
KEY = "unhex(sha2(coalesce(text, ''), 256))"


def columns(df: DataFrame) -> list:
    """The columns by name, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``marked`` says of every row of ``docs`` (doc_id, key, kept), with ``key`` as by ``KEY``.
    Rows equal in id and text have one fate, but that of several copies as many stay as
    are marked: none, all, or, of copies of which one is kept, one.
    """
    fates = marked.groupBy(F.col("doc_id").alias("__tl_id"), F.col("key").alias("__tl_key")).agg(F.count_if("kept").alias("__tl_kept"), F.count("*").alias("__tl_rows"))
    odd = only(lambda: fates.filter("__tl_kept < __tl_rows"))
    keyed = docs.withColumn("__tl_row_key", F.expr(KEY))
    doc_id = F.col("doc_id").cast("long")
    at = F.pmod(F.xxhash64(doc_id, "__tl_row_key"), F.lit(FILTER_BITS))
    # most rows are told by a filter of fixed size, and their texts not shuffled
    bits = _bits(odd.select(F.pmod(F.xxhash64("__tl_id", "__tl_key"), F.lit(FILTER_BITS)).alias("at")))
    hit = F.getbit(F.get(bits.scalar(), F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    met = keyed.filter(hit)
    same = doc_id.eqNullSafe(F.col("__tl_id")) & (F.col("__tl_row_key") == F.col("__tl_key"))
    out = keyed.filter(~hit).unionByName(met.join(odd.select("__tl_id", "__tl_key"), same, "left_anti")).select(*columns(docs))
    if not odd.filter("__tl_kept > 0").limit(1).count():
        return out
    # copies of one row of which one stays: they are alike in id and text, so any of them will do
    one = met.join(odd.filter("__tl_kept > 0").select("__tl_id", "__tl_key"), same, "left_semi").groupBy(doc_id.alias("__tl_id"), "__tl_row_key").agg(F.first(F.struct(*columns(docs))).alias("__tl_row"))
    return out.unionByName(one.select("__tl_row.*"))


#: Bits of the filter that spares the texts of rows that certainly stay a shuffle: 1 MB however many rows go.
FILTER_BITS = 1 << 23


def _bits(places: DataFrame) -> DataFrame:
    """One row with an array of 64-bit words in which the bits at the given places (``at``) are set."""
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return places.sparkSession.createDataFrame([(table.tolist(),)], "bits array<long>")


def parts_for(rows: int, per_part: int) -> int:
    """Partitions so that each holds about ``per_part`` rows, however large the input."""
    return max(1, -(-rows // per_part))


def release() -> None:
    """Gives back what this worker has freed, so that it waits for its next task without holding it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch; batches that are empty are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
        release()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null is empty."""
    col = pc.fill_null(column, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()
