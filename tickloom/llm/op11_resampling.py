"""Target-distribution importance resampling: array-scored weights, then a draw by merging sorted runs.

Features of a text are its runs of up to ``LONGEST`` words; a feature's bucket is
the CRC-32 of its bytes modulo ``BUCKETS``.  A bucket gains what it is more
frequent in the target than in the documents, as the thousandfold logarithm of
the smoothed ratio, downwards, and a document weighs the mean gain of its
features, downwards.  A Gumbel draw by document id is added, so that the highest
scores are a sample without replacement in proportion to exp(weight / 1000).

Words of a block are found and hashed as arrays: one step a byte position moves
the checksums of all words that are long enough.  The counts of buckets and the
gains are arrays of ``BUCKETS`` numbers, whatever the size of the corpus.

The draw: each partition sorts its eligible rows (highest score, then smallest
id) into one run, which is cut into blocks at the borders of up to ``RANGES``
ranges of that order; the borders come from a bounded sample of keys and only
deal out work.  The blocks of a range come to one task in order of their first
keys, so a tournament tree over the runs opens a block when its first key is
next, and holds at most one block of each run.  Runs beyond ``FAN`` are merged
level by level by the same step, with a table between.  The number of rows in
each range gives the rank of its first, ranges behind the last rank are not
read, and the merge stops at it.

Defined results: a null text has no words; words are runs of the characters that
the pattern of the docstring of ``words`` names, of whole texts of any length; a
null id draws as an empty one and comes after all ids of its score; rows equal in
score and id are drawn in the order read; an empty table gives no rows, an empty
target gives gains from the documents alone; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblock

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
#: Words that a document needs to be drawn, and the share of those that have them that is drawn.
LEAST_WORDS = 20
PERCENT = 10
#: Ranges of the order that are merged apart: as many at most, of about so many rows at least.
RANGES, PER_RANGE = 4096, 20_000
#: Keys of a range in the sample that sets borders, about.
PER_BORDER = 16
BLOCK = 4096
#: Runs that one tournament merges.
FAN = 1000
#: Bytes of a word that are hashed as arrays; what is behind them is hashed word by word.
LONG = 48

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, and the words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = _WORD[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = solid[begin]
    last[begin[begin > 0] - 1] = solid[begin[begin > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def advanced(state: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes ``low[start:end]`` of each word."""
    size = ends - starts
    order = np.argsort(255 - np.minimum(size, 255).astype(np.uint8), kind="stable")
    # longest first, so the words that have a p-th byte are a prefix
    s, at = state[order], starts[order]
    longer = len(s) - np.cumsum(np.bincount(np.minimum(size, LONG), minlength=LONG + 1))
    for p in range(min(LONG, int(size.max(initial=0)))):
        m = int(longer[p])
        s[:m] = _CRC[(s[:m] ^ low[at[:m] + p]) & 255] ^ (s[:m] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(low[starts[k] + LONG : ends[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def buckets(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the text that has it, and the words of each text."""
    starts, ends, n = words(data, offsets)
    low, text = _LOW[data], np.repeat(np.arange(len(n)), n)
    here, state = np.arange(len(starts)), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found, owner = [], []
    for k in range(longest):
        if k:
            on = here + k < len(starts)
            on[on] = text[here[on] + k] == text[here[on]]
            here, state = here[on], state[on]
            state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
        state = advanced(state, low, starts[here + k], ends[here + k])
        found.append((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % BUCKETS)
        owner.append(text[here])
    return np.concatenate(found), np.concatenate(owner), n


def _blocks(column: pa.Array, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, off = common.utf8(column)
    for i, j in textblock.blocks(off, 1 << 20):
        yield i, j, *buckets(data[off[i] : off[j]], off[i : j + 1] - off[i], longest)


def counts(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, found, _, _ in _blocks(batch.column(0), longest):
                total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])
        common.release()

    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """What each bucket gains, in thousandths, from the counts of the documents and of the target."""
    s, t = int(have.sum()) + BUCKETS, int(want.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(((b + 1) * s) / ((a + 1) * t))) for a, b in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document; ``row`` holds for as long as the result is stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for i, j, found, owner, own in _blocks(batch.column(3), longest):
            n_words[i:j] = own
            n[i:j] = np.bincount(owner, minlength=j - i)
            np.add.at(weight, owner + i, gain[found])
        weight //= np.maximum(n, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in (n_words, n, weight, weight + batch.column(2).to_numpy()))], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long").alias("drawn")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), drawn, "text")
    return common.map_batches(rows, run, "row long, doc_id long, n_words long, n_features long, weight long, score long")


# ---- the draw ----

#: A null id comes after all others.
_LAST_ID = (1 << 63) - 1
_BLOCK = "range int, run long, score long, id long, row long, n long, body binary"
_FIELDS = ["score", "id", "row", "null", "n_features", "weight"]


def _packed(at: int, run: int, rows: np.ndarray) -> tuple:
    """A block of rows (score, id, row, null, n_features, weight) under its first key."""
    return at, run, *(int(x) for x in rows[0, :3]), len(rows), np.ascontiguousarray(rows, np.int64).tobytes()


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


class Tournament:
    """Matches between the heads of runs: a node holds the entrant whose head is least of all below it."""

    def __init__(self) -> None:
        self.size = 1
        self.heads: list[tuple | None] = [None]
        self.tree = [0, 0]

    def best(self) -> int:
        return self.tree[1]

    def place(self, entrant: int, head: tuple | None) -> None:
        """A new head for an entrant, None if it has none now, and the matches on its way up."""
        while entrant >= self.size:
            self.heads += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self._play(node)
        self.heads[entrant] = head
        node = (self.size + entrant) >> 1
        while node:
            self._play(node)
            node >>= 1

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self.tree[node] = a if y is None or (x is not None and x <= y) else b


def merged(blocks: Iterator[tuple[int, bytes]]) -> Iterator[list[int]]:
    """The rows of (run, body) in order of their keys; blocks come in order of their first keys."""
    game, entrants, left = Tournament(), {}, {}
    ahead = next(blocks, None)

    def key(row: list[int]) -> tuple:
        return -row[0], row[1], row[2]

    while True:
        head = game.heads[game.best()]
        if ahead is not None:
            run, body = ahead
            rows = np.frombuffer(body, np.int64).reshape(-1, len(_FIELDS))
            if head is None or key(rows[0].tolist()) <= head:
                at = entrants.setdefault(run, len(entrants))
                left[at] = iter(rows.tolist())
                first = next(left[at])
                game.place(at, (*key(first), first))
                ahead = next(blocks, None)
                continue
        if head is None:
            return
        yield head[3]
        at = game.best()
        row = next(left[at], None)
        game.place(at, None if row is None else (*key(row), row))


def runs(eligible: DataFrame, borders: list[tuple]) -> DataFrame:
    """The rows of each partition in order, as one run of blocks, each within one of the ranges between the borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(len(_FIELDS))], 1)
            i = 0
            while i < len(rows):
                stop = len(rows)
                if at < len(borders):
                    # rows below the next border, by its three parts
                    s, d, r = borders[at]
                    a, b, c = rows[i:, 0], rows[i:, 1], rows[i:, 2]
                    stop = i + int(np.count_nonzero((a > s) | ((a == s) & ((b < d) | ((b == d) & (c < r))))))
                if stop > i:
                    held.append(rows[i:stop])
                i = stop
                if i < len(rows) or sum(map(len, held)) >= BLOCK:
                    if held:
                        yield _batch([_packed(at, part, np.concatenate(held))])
                        held = []
                    at += i < len(rows)
        if held:
            yield _batch([_packed(at, part, np.concatenate(held))])
        common.release()

    keyed = eligible.select("score", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), "row", F.col("doc_id").isNull().cast("long").alias("null"), "n_features", "weight")
    return keyed.sortWithinPartitions(F.desc("score"), "id", "row").mapInArrow(run, _BLOCK)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple[int, bytes]]]]:
    """(range, into) and the (run, body) of its blocks; what a reader leaves of a group is passed over."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
    ahead = next(rows, None)

    def own(now: tuple[int, int]) -> Iterator[tuple[int, bytes]]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == now:
            _, _, run, body = ahead
            yield run, body
            ahead = next(rows, None)

    while ahead is not None:
        now = ahead[:2]
        group = own(now)
        yield now, group
        for _ in group:
            pass


def _dealt(blocks: DataFrame, fan: int) -> DataFrame:
    into = F.floor(F.col("run") / fan).alias("into")
    keyed = blocks.select("range", into, "run", "body", "score", "id", "row")
    return keyed.repartition("range", "into").sortWithinPartitions("range", "into", F.desc("score"), "id", "row").select("range", "into", "run", "body")


def combined(blocks: DataFrame, fan: int) -> DataFrame:
    """Blocks of longer runs: every ``fan`` runs become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, into), group in _groups(batches):
            held: list = []
            for row in merged(group):
                held.append(row)
                if len(held) == BLOCK:
                    yield _batch([_packed(at, into, np.array(held))])
                    held = []
            if held:
                yield _batch([_packed(at, into, np.array(held))])
        common.release()

    return _dealt(blocks, fan).mapInArrow(run, _BLOCK)


def ranked(blocks: DataFrame, firsts: dict[int, int], count: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, row): each range merged into one, from the rank of its first row to ``count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_features", "weight", "score", "rank", "row"]
        for (at, _), group in _groups(batches):
            rank, held = firsts[at], []
            for row in merged(group):
                if rank >= count:
                    break
                rank += 1
                score, own, place, null, n, weight = row
                held.append((None if null else own, n, weight, score, rank, place))
                if len(held) == BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
        common.release()

    return _dealt(blocks, 1 << 62).mapInArrow(run, "doc_id long, n_features long, weight long, score long, rank long, row long")


def drawn(rows: DataFrame, count: int, eligible: int) -> DataFrame | None:
    """The ``count`` first of stored rows in order of (score downwards, doc_id, row), with their ranks from 1."""
    if not count:
        return None
    ranges = min(RANGES, common.parts_for(eligible, PER_RANGE))
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, eligible // (ranges * PER_BORDER)))) == 0) if ranges > 1 else rows.limit(0)
    # about RANGES * PER_BORDER keys at most
    keys = some.select("score", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), "row").toArrow().to_pylist()
    order = sorted((-x["score"], x["id"], x["row"]) for x in keys)
    borders = sorted({order[k * len(order) // ranges] for k in range(1, ranges)}) if order else []
    blocks = common.stored(runs(rows, [(-a, b, c) for a, b, c in borders]))
    sizes = dict(sorted((r["range"], r["n"]) for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()))  # a row a range
    before, firsts = 0, {}
    for at, n in sizes.items():
        if before < count:
            firsts[at] = before
        before += n
    blocks = blocks.filter(F.col("range") <= max(firsts))
    most = blocks.agg(F.max("run")).first()[0] + 1
    while most > FAN:
        blocks = common.stored(combined(blocks, FAN))
        most = -(-most // FAN)
    return common.stored(ranked(blocks, firsts, count))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and the rank of those drawn."""
    return common.only(lambda: _resampled(docs, target, longest))


def _resampled(docs: DataFrame, target: DataFrame, longest: int) -> DataFrame:
    rows = common.stored(scored(docs, gains(counts(docs, longest), counts(target, longest)), longest))
    able = rows.filter(F.col("n_words") >= LEAST_WORDS)
    eligible = able.count()
    count = PERCENT * eligible // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows.withColumn("rank", F.lit(None).cast("long"))
    first = drawn(able, count, eligible)
    if first is None:
        return rest.select(out)
    last = first.filter(F.col("rank") == count).first()
    place = F.coalesce("doc_id", F.lit(_LAST_ID))
    own, score, row = _LAST_ID if last.doc_id is None else last.doc_id, F.col("score"), F.col("row")
    # what was drawn ends at one key, so the others need no join
    taken = (F.col("n_words") >= LEAST_WORDS) & ((score > last.score) | ((score == last.score) & ((place < own) | ((place == own) & (row <= last.row)))))
    return first.select(out).unionByName(rest.filter(~taken).select(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH bits AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))
), texts AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, 0, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), features AS (
  SELECT kind, r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), hashed AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(a // 256, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM features), bits
), counted AS (
  SELECT kind, r, bucket, count(*) AS n FROM features JOIN hashed USING (word) GROUP BY ALL
), have AS (
  SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM counted GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM have
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain FROM have, totals
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r
), scores AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE kind = 0
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, r) END AS k, count(*) FILTER (n_features >= 20) OVER () AS able FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * able // 100 THEN k END AS rank FROM ranked
"""
