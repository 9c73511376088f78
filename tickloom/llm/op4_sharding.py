"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Every group of equal texts is a partial partition with its bytes in one bin.
The two partial partitions with the largest spread are combined again and
again, oppositely ordered (largest bin with smallest), until one is left.

At scale this runs level by level with the same step: each task differences
chunks of at most ``PER_CHUNK`` groups down to one partial partition of
``shards`` bins, then tasks combine ``FAN`` of these into one, and so on until
one is left.  Nothing but counts comes to the driver.  Row numbers within a
shard come from counts by (shard, hash bucket), so no task sorts a shard.

Defined results: a null text has no bytes and is equal to an empty one; rows
are numbered as they are read, whatever their ids; a group larger than an even
share stays whole, as groups are indivisible, and so does a text of any length;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PER_CHUNK = 50_000
#: Partial partitions that a task combines into one, about.
FAN = 1_000
#: Rows numbered by one window partition, about.
PER_BUCKET = 50_000


def difference(partitions: list[list[int]], k: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions of up to ``k`` bins.

    Returns, for each partition, the final bin of each of its bins.  Ties of
    spread go to the earlier partition, so the result is the same every time.
    """
    heap = []
    for p, sums in enumerate(partitions):
        bins = sorted(((s, (p, j)) for j, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))
        bins += [(0, None)] * (k - len(bins))
        heap.append((bins[-1][0] - bins[0][0], p, bins))
    heapq.heapify(heap)
    serial = len(partitions)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        bins = [(x[0] + y[0], x[1] if y[1] is None else y[1] if x[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        bins.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], serial, bins))
        serial += 1
    out = [[0] * len(sums) for sums in partitions]
    for final, (_, node) in enumerate(heap[0][2] if heap else []):
        todo = [] if node is None else [node]
        while todo:
            a, b = todo.pop()
            if isinstance(a, tuple):
                todo += [a, b]
            else:
                out[a][b] = final
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, text_crc32, digest) of every document; ``row`` holds for as long as the result is stored."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.expr("substring(unhex(sha2(coalesce(text, ''), 256)), 1, 16)").alias("digest"))


def balanced_groups(groups: DataFrame, shards: int, rows: int) -> DataFrame:
    """(digest, shard) for (digest, size): every group whole, shard sums near equal."""
    per_chunk = PER_CHUNK

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        sizes: list = []
        part, serial = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            bins = [x[0] for x in difference([[s] for s in sizes], shards)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([part << 32 | serial] * len(keys), pa.int64()), pa.array(bins, pa.int32())], ["digest", "size", "chunk", "bin"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            if len(keys) >= per_chunk:
                yield flush()
                keys, sizes, serial = [], [], serial + 1
        if keys:
            yield flush()

    parts = max(common.parts_for(rows, PER_CHUNK), 1)
    dealt = groups.repartition(parts, "digest").sortWithinPartitions("digest")
    chunks = common.stored(dealt.mapInArrow(chunked, "digest binary, size long, chunk long, bin int"))
    moves = combined(chunks.groupBy("chunk", "bin").agg(F.sum("size").alias("size")), shards)
    return chunks.join(moves, ["chunk", "bin"]).select("digest", "shard")


def combined(sums: DataFrame, shards: int) -> DataFrame:
    """(chunk, bin, shard): where the bins of all partial partitions of (chunk, bin, size) end, level by level."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, dict[int, int]] = {}
        for batch in batches:
            for chunk, own, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(chunk, {})[own] = size
        if held:
            names = sorted(held)
            bins = [sorted(held[x]) for x in names]
            final = difference([[held[x][k] for k in own] for x, own in zip(names, bins, strict=True)], shards)
            rows = [(x, k, part, f, held[x][k]) for x, own, ends in zip(names, bins, final, strict=True) for k, f in zip(own, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["chunk", "bin", "into", "slot", "size"])

    moves = None
    while True:
        parts = common.parts_for(sums.select("chunk").distinct().count(), FAN)
        level = common.stored(sums.select("chunk", "bin", "size").repartition(parts, "chunk").mapInArrow(step, "chunk long, bin int, into long, slot int, size long"))
        now = level.select("chunk", "bin", "into", "slot")
        if moves is None:
            moves = now
        else:
            moves = moves.join(now.select(F.col("chunk").alias("into"), F.col("bin").alias("slot"), F.col("into").alias("into_2"), F.col("slot").alias("slot_2")), ["into", "slot"]).select("chunk", "bin", F.col("into_2").alias("into"), F.col("slot_2").alias("slot"))
        if parts == 1:
            return moves.select("chunk", "bin", F.col("slot").alias("shard"))
        sums = level.groupBy(F.col("into").alias("chunk"), F.col("slot").alias("bin")).agg(F.sum("size").alias("size"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document with its shard and its place (slot) in the shard."""
    return common.only(lambda: _shard_documents(docs, shards))


def _shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    rows = common.stored(sized(docs))
    n = rows.count()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    buckets = common.parts_for(n, PER_BUCKET)
    at = F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")
    dealt = common.stored(rows.join(balanced_groups(groups, shards, n), "digest").select("doc_id", "row", "size", "text_crc32", "shard", at))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = dealt.withColumn("n", F.row_number().over(own)).join(first, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
