"""Exact deduplication over a cuckoo-filter index.

``CuckooIndex`` is a cuckoo filter whose buckets also keep the full digest and
a payload of each live entry: a fingerprint hit is verified against that
content, entries can be deleted, and an insertion that finds no room doubles
the table and rebuilds it from the stored keys.

``exact_groups`` is the distributed form.  Digests are formed where the texts
are read, copies are combined before the shuffle, and each digest partition
owns one index.  Copies found in the index replace the live entry's payload
(the row that stays so far and the row count).

Defined results: a null text counts as empty; the row with the largest id
stays, one row of a group and no more: where rows share that id, the last one
read; a null id is kept only where its group has no other; repeated rows are
copies of one another; a text of any length is hashed whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct digests that one index holds.
PER_INDEX = 250_000


class CuckooIndex:
    """Fingerprints of 16 bits in buckets of four, each slot with its digest and payload."""

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, capacity: int = 64) -> None:
        self._build(max(2, 1 << (max(1, capacity) * 10 // (9 * self.SLOTS)).bit_length()))
        self.size = 0
        self.resizes = 0
        self.false_hits = 0

    def _build(self, buckets: int) -> None:
        self.buckets = buckets
        self.tags = [0] * (buckets * self.SLOTS)
        self.content: list = [None] * (buckets * self.SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return tag, one, self._other(one, tag)

    def _other(self, bucket: int, tag: int) -> int:
        """The second bucket, an involution, as partial-key cuckoo hashing needs."""
        return bucket ^ ((tag * 0x5BD1E995 ^ tag >> 3) & (self.buckets - 1))

    def _slot(self, digest: bytes) -> int:
        tag, one, two = self._places(digest)
        tags, content = self.tags, self.content
        for bucket in (one, two):
            base = bucket * 4
            for slot in range(base, base + 4):
                if tags[slot] == tag:
                    if content[slot][0] == digest:
                        return slot
                    self.false_hits += 1
        return -1

    def get(self, digest: bytes):
        """The payload of a live digest, else None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.content[slot][1]

    def __contains__(self, digest: bytes) -> bool:
        return self._slot(digest) >= 0

    def replace(self, digest: bytes, payload) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.content[slot] = (digest, payload)
        return True

    def insert(self, digest: bytes, payload) -> None:
        """Adds a digest that is not live."""
        entry = (digest, payload)
        while (entry := self._place(entry)) is not None:
            self._grow()
        self.size += 1

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.tags[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (x for x in self.content if x is not None)

    def _place(self, entry):
        """None, or the entry that was left over after the last kick."""
        tags, content = self.tags, self.content
        tag, one, two = self._places(entry[0])
        for bucket in (one, two):
            for slot in range(bucket * 4, bucket * 4 + 4):
                if not tags[slot]:
                    tags[slot], content[slot] = tag, entry
                    return None
        bucket = two
        for kick in range(self.MAX_KICKS):
            slot = bucket * 4 + (tag + kick) % 4
            tag, tags[slot] = tags[slot], tag
            entry, content[slot] = content[slot], entry
            bucket = self._other(bucket, tag)
            for slot in range(bucket * 4, bucket * 4 + 4):
                if not tags[slot]:
                    tags[slot], content[slot] = tag, entry
                    return None
        return entry

    def _grow(self) -> None:
        """Twice the buckets, filled anew from the stored keys; again if that overflows."""
        live, size = list(self.items()), self.buckets
        while True:
            size *= 2
            self.resizes += 1
            self._build(size)
            if all(self._place(x) is None for x in live):
                return


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, digest): SHA-256 of each whole text, A-Z lower-cased, in UTF-8; ``key`` as by ``common.KEY``.

    ``row`` numbers the rows as they are read; it holds for as long as the result is stored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = common.utf8(batch.column(3))
        view = data.tobytes().lower()
        found = [hashlib.sha256(view[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.binary())], ["doc_id", "row", "key", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.expr(common.KEY).alias("key"), "text")
    return common.map_batches(rows, run, "doc_id long, row long, key binary, digest binary")


def exact_groups(rows: DataFrame) -> DataFrame:
    """Of (doc_id, row, digest): one row per digest with keep_id, keep_row, group_size, found by the index."""
    lowest = -(2**63)
    partial = rows.groupBy("digest", F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("doc_id"), F.max_by("row", F.coalesce("doc_id", F.lit(lowest))).alias("row"), F.count("*").alias("n")).drop("part")
    parts = max(common.parts_for(rows.count(), PER_INDEX), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for digest, top, row, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held, found = live.get(digest), (lowest if top is None else top, top is not None, row)
                if held is None:
                    live.insert(digest, (found, n))
                else:
                    live.replace(digest, (max(held[0], found), held[1] + n))
        found = list(live.items())
        for k in range(0, len(found), 10_000):
            some = found[k : k + 10_000]
            kept = [x[1][0] for x in some]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.binary()), pa.array([a if known else None for a, known, _ in kept], pa.int64()), pa.array([r for _, _, r in kept], pa.int64()), pa.array([x[1][1] for x in some], pa.int64())], ["digest", "keep_id", "keep_row", "group_size"])

    return partial.repartition(parts, "digest").mapInArrow(index, "digest binary, keep_id long, keep_row long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key."""
    rows = common.stored(digests(docs))
    groups = exact_groups(rows)
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with all its columns; the cases are those of the module."""
    common.session(spark)
    return common.without(docs, exact_dedup(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents")).drop("key")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, place = 1 AS kept, text_sha256 FROM g
"""
