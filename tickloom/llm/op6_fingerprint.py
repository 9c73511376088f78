"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line or, within a line, a piece that ends at a sentence end;
its digest also counts the earlier equal paragraphs of the text.  A sketch has
three tables of cells; each digest goes into one cell of each: a count, the
exclusive or of digests, and that of their check sums.  Two sketches subtract
cell by cell, and peeling takes out of the difference one digest after the
other.  Where cells are left, both sketches are built again, larger, and
peeled again.  Likeness is (|A| + |B| - |D|) / (|A| + |B| + |D|) with D the
recovered difference: the Jaccard index of the two paragraph sets.

The cells of a batch of documents lie in one array, so building, subtracting
and peeling are a few array operations for the whole batch.

The next document of each is found without a global sort: documents are cut by
ids that are in the table into buckets, each bucket is read in descending order,
and the first document of a bucket is sent to the bucket before it as well.  The
cuts are the ids that a hash picks, eight in ``PER_BUCKET`` or, in a very large
table, so few that about ``CUTS`` come to the driver; a task reads many buckets.

Defined results: null texts count as empty; two texts without paragraphs are
alike (1.0); a null doc_id comes last, and equal ids, which share a bucket,
follow by text; texts of any length are fingerprinted whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textblock import mix

#: Cells of each of the three tables of a fingerprint.
CELLS = 8
TABLES = 3
PER_BUCKET = 2_000
#: Buckets at most, about: their cuts are 8 bytes each on the driver and in a broadcast.
CUTS = 1_000_000

_PIECE = re.compile(r"\n+|(?<=[.!?]) +")
_U = np.uint64
_SALTS = [_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0)]


def paragraphs(text: str) -> list[int]:
    """64-bit digests of the paragraphs; equal paragraphs of one text get digests of their own."""
    seen: Counter = Counter()
    out = []
    for piece in _PIECE.split(text):
        if piece and not piece.isspace():
            n = seen[piece]
            seen[piece] += 1
            raw = piece.encode() if not n else b"%d\n" % n + piece.encode()
            out.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))
    return out


class Sets:
    """Sets of digests, one after the other in one array."""

    def __init__(self, sets: list[list[int]]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.keys = np.array([k for x in sets for k in x], np.uint64)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def of(self, rows: np.ndarray) -> Sets:
        """The sets of the given rows, numbered anew; a row may come again."""
        out = object.__new__(Sets)
        out.sizes = self.sizes[rows]
        first = np.concatenate(([0], np.cumsum(self.sizes)))[rows]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(out.sizes)[:-1])), out.sizes) + np.arange(int(out.sizes.sum()))
        out.keys, out.owner = self.keys[at], np.repeat(np.arange(len(rows)), out.sizes)
        return out


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0x082EFA98EC4E6C89)) >> _U(32)).astype(np.uint32)


def _cells(keys: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    """For each table, where each key's cell lies in the flat array."""
    return [(owner * TABLES + t) * cells + (mix(keys + salt) % _U(cells)).astype(np.int64) for t, salt in enumerate(_SALTS)]


def sketch(sets: Sets, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and check sums of the cells of all sets, flat."""
    n = len(sets.sizes) * TABLES * cells
    count, key, check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    sums = _check(sets.keys)
    for at in _cells(sets.keys, sets.owner, cells):
        count += np.bincount(at, minlength=n).astype(np.int32)
        np.bitwise_xor.at(key, at, sets.keys)
        np.bitwise_xor.at(check, at, sums)
    return count, key, check


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of subtracted sketches: owners and signed digests recovered, and which owners came out whole.

    Returns (owner of each digest, its digest, failed owners); the arrays given are used up.
    """
    per = TABLES * cells
    owners, keys = [], []
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (check == _check(key)))
        if not len(pure):
            break
        found = np.unique(np.rec.fromarrays([pure // per, key[pure], count[pure]], names="o,k,s"))
        o, k, s = found["o"], found["k"], found["s"]
        owners.append(o)
        keys.append(k)
        sums = _check(k)
        for at in _cells(k, o, cells):
            np.subtract.at(count, at, s)
            np.bitwise_xor.at(key, at, k)
            np.bitwise_xor.at(check, at, sums)
    left = (count != 0) | (key != 0) | (check != 0)
    failed = np.unique(np.flatnonzero(left) // per)
    none = np.zeros(0, np.int64)
    return np.concatenate(owners or [none]), np.concatenate(keys or [none.astype(np.uint64)]), failed


def differences(a: Sets, b: Sets, cells: int = CELLS) -> np.ndarray:
    """The size of the difference of each pair of sets, retried with larger sketches where peeling fails."""
    out = np.zeros(len(a.sizes), np.int64)
    rows = np.arange(len(a.sizes))
    while len(rows):
        x, y = a.of(rows), b.of(rows)
        one, two = sketch(x, cells), sketch(y, cells)
        owner, _, failed = peel(one[0] - two[0], one[1] ^ two[1], one[2] ^ two[2], cells)
        got = np.bincount(owner.astype(np.int64), minlength=len(rows))
        good = np.ones(len(rows), bool)
        good[failed] = False
        out[rows[good]] = got[good]
        rows = rows[failed]
        if len(rows):
            # as large as the middle of the sets left needs; those left again double it
            cells = max(2 * cells, int(np.median(a.sizes[rows] + b.sizes[rows])) * 2 // TABLES + 4)
    return out


def likeness(a: Sets, b: Sets, cells: int = CELLS) -> np.ndarray:
    both, apart = a.sizes + b.sizes, differences(a, b, cells)
    return np.where(both + apart > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def serialised(sets: Sets, cells: int = CELLS) -> list[str]:
    """Each sketch as base64: counts, digests, check sums."""
    count, key, check = (x.reshape(len(sets.sizes), -1) for x in sketch(sets, cells))
    return [base64.b64encode(c.astype("<i4").tobytes() + k.astype("<u8").tobytes() + s.astype("<u4").tobytes()).decode() for c, k, s in zip(count, key, check, strict=True)]


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, own, doc_id, text) so dealt and sorted that each own row stands before its next document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lowest = -(2**63)
    ids = docs.select(F.coalesce("doc_id", F.lit(lowest)).alias("id"))
    n = ids.count()
    every = max(1, PER_BUCKET // 8, n // CUTS)
    found = [x[0] for x in ids.filter((F.col("id") > lowest) & (F.pmod(F.xxhash64(F.lit(every), "id"), F.lit(every)) == 0)).distinct().collect()]
    top = ids.filter(F.col("id") > lowest).agg(F.max("id")).first()[0]
    held = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([*found, *([] if top is None else [top])], np.int64)))

    has_null = bool(n) and ids.filter(F.col("id") == lowest).limit(1).count() > 0
    last = -1 if has_null else 0

    @F.pandas_udf("array<int>")
    def places(column: pd.Series) -> pd.Series:
        """An id's bucket, and for the first of a bucket also the bucket that is read before it.

        Bucket b holds the ids up to cuts[b] and above cuts[b - 1], so b + 1 is read before b;
        before the top stands the last of all, bucket 0, or -1 with the null ids.
        """
        cuts, value = held.value, column.to_numpy(np.int64)
        at = np.searchsorted(cuts, value, "left")
        first = cuts[np.minimum(at, len(cuts) - 1)] == value if len(cuts) else value != lowest
        return pd.Series([[-1, 0 if len(cuts) else -1] if v == lowest else [p, p + 1 if p + 1 < len(cuts) else last] if f else [p] for v, p, f in zip(value.tolist(), at.tolist(), first.tolist(), strict=True)])

    parts = max(common.parts_for(n, 4 * PER_BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kid = F.coalesce("doc_id", F.lit(lowest))
    dealt = docs.withColumn("places", places(kid)).select("*", F.posexplode("places").alias("twice", "bucket")).select("bucket", (F.col("twice") == 0).alias("own"), "doc_id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "text")


NAMES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike it is to that and to the next document."""

    def rows(some: list[tuple]) -> pa.RecordBatch:
        ids, own, after = zip(*some, strict=True)
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(own, after, strict=True)]
        sets = [paragraphs(t) for t in (*own[:1], *after)] if all(a is b for a, b in zip(own[1:], after, strict=False)) else None
        mine = Sets(sets[:-1] if sets else [paragraphs(t) for t in own])
        following = Sets(sets[1:] if sets else [paragraphs(t) for t in after])
        changed = Sets([paragraphs(t) for t in edited])
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(hashes), pa.array(serialised(mine, cells)), pa.array(serialised(changed, cells)), pa.array(likeness(mine, changed, cells)), pa.array(likeness(mine, following, cells))], [x.split()[0] for x in NAMES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            some = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is not None and held[1]:
                    if row[0] != held[0]:
                        raise ValueError(f"bucket {held[0]} has no document that follows its last")
                    some.append((held[2], held[3], row[3]))
                held = row
            if some:
                yield rows(some)
        if held is not None and held[1]:
            raise ValueError(f"bucket {held[0]} has no document that follows its last")

    return with_next(docs).mapInArrow(run, NAMES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
