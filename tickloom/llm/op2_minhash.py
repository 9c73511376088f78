"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; a shingle weighs its count
times 1 + min(1, ln(1 / f) / ln(1 / RARE)), where f = (df + 1) / (N + 1) is the
share of documents that have it: 1 if all do, 2 if at most ``RARE`` of them do.
So a weight hangs on a share and not on the size of the corpus.  Document
frequencies are counted over all documents in two tables of ``DF_CELLS`` hashed
cells, of which the lesser count is taken.  What falls into a cell besides is
about the mean number of shingles a document over ``DF_CELLS`` as a share, at
any size of the corpus, and below ``RARE`` it changes nothing.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples a text:
for sample i and a shingle of weight w, t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta) - r, and the shingle of least a is the sample, with
its t.  r and c (Gamma 2, 1) and beta (uniform) come from a table that hashes
of shingle and i index.  Texts that share all samples of a band are candidates.

Candidates are verified by the weighted Jaccard similarity of whole texts.
Exact copies are one node.  In each bucket of a band all nodes are compared
with one pivot.  That leaves the pairs of other nodes, of which only those in
different components matter: buckets that still span components are compared
with further pivots, more each round, until every such pair of every bucket was
compared or ruled out.  A node is closed where what it has in shingles that no
other open node has leaves too little to share with any partner, and so is a
pair of a small bucket, or one whose similarities to their pivot differ by more
than 1 - SIMILARITY, as 1 - weighted Jaccard is a metric.  Pivots and nodes of
large buckets go to tasks in blocks of bounded weight: a task has each text once,
takes all its similarities as products of matrices, and hands on no more links
than it takes to join what they join.  So a round has a row for each node and
block of pivots, and not for each pair, and no link that joins two classes is
lost.  Where pivots link, buckets end after a round or two; the products in a
bucket of m nodes of which none ever links are m^2, its rows m^2 / BLOCK.
Classes are connected components.

Defined results: a null text counts as empty; texts without words are copies
of one another; a text of fewer than five words has one shingle of all its
words; words are compared after lower-casing A-Z; the row with the largest id of a
class stays, and no other: where rows share that id, the last one read; a class
without an id keeps one of its rows; texts of any length are read whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textblock

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
DF_CELLS = 1 << 18
#: Shingles in this share of the documents or fewer weigh most.
RARE = 0.01
#: Nodes of a bucket that go to one task, about.
PER_SALT = 500
#: Rows of document frequencies travel in slices.
SLICES = 64
#: Bits of the filter that spares the texts of documents without candidates a shuffle.
FILTER_BITS = 1 << 23
#: Buckets of so few nodes are compared pair by pair at once.
SMALL = 12
#: Nodes of a larger bucket that go to one task as a block, about, and the weight they may have together.
BLOCK, BLOCK_WEIGHT = 128, 1 << 17
#: Shingles that a product of matrices takes at once.
COLUMNS = 1 << 11
#: Further pivots a bucket gets in the first round, and how many times more in each next one.
PIVOTS, MORE = BLOCK, 16

_U = np.uint64
_TABLE = 1 << 16


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, 1 / r, ln c and beta, by a rule that gives the same numbers everywhere."""
    u = [(textblock.mix(np.arange(1, _TABLE + 1, dtype=np.uint64) + _U(k << 32)) >> _U(11)) / 2.0**53 + 2.0**-54 for k in range(5)]
    r = -np.log(u[0]) - np.log(u[1])
    return tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(-np.log(u[2]) - np.log(u[3])), u[4]))


_R, _INVERSE, _LNC, _BETA = _draws()
_FACTORS = [_U(textblock.mix_int(1000 + i) | 1) for i in range(256)]


def samples(keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each text with keys, as 32-bit identities of (shingle, t).

    One 64-bit minimum finds each sample: the bits of ln a, moved above zero, stand over the identity.
    """
    used = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), count), np.uint32)
    if not len(used):
        return out
    first = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
    spread = textblock.mix(keys)
    low = (spread & _U(0xFFFFFFFF)).astype(np.uint32)
    ln_w = np.log(weights).astype(np.float32)
    for i in range(count):
        at = (spread * _FACTORS[i]) >> _U(48)
        r = _R[at]
        beta = _BETA[at]
        t = np.floor(ln_w * _INVERSE[at] + beta)
        ln_a = _LNC[at] - r * (t - beta + 1) + np.float32(128)
        name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        best = np.minimum.reduceat(ln_a.view(np.uint32).astype(np.uint64) << _U(32) | name, first)
        out[used, i] = (best & _U(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    n = len(drawn)
    wide = drawn.reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = textblock.mix(key * _U(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key.view(np.int64)


def weight_of(keys: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weight of one occurrence of each shingle."""
    return np.maximum(*(table[at] for table, at in zip(idf, cells_of(keys), strict=True)))


def cells_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of 48-bit keys in either table: their upper and their lower bits."""
    return (keys >> _U(30)).astype(np.int64), (keys & _U(DF_CELLS - 1)).astype(np.int64)


class Texts:
    """Digests and weighted shingles of the texts of a column, block by block."""

    def __init__(self, column: pa.Array, idf: np.ndarray | None) -> None:
        self.data, self.off = common.utf8(column)
        self.idf = idf

    def __iter__(self) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """First and last text, digests of the words, keys, weights and how many each text has."""
        for i, j in textblock.blocks(self.off, 1 << 19):
            words, counts = textblock.word_hashes(self.data[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])
            raw, at = words.tobytes(), np.concatenate([[0], np.cumsum(counts) * 8]).tolist()
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            keys, tf, sizes = textblock.counted(*textblock.shingles(words, counts, WIDTH))
            weights = tf if self.idf is None else tf * weight_of(keys, self.idf)
            yield i, j, digests, keys, weights, sizes


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weights of the cells of both tables, from document frequencies over all documents; a shingle has the greater of its two."""
    width = DF_CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros((2, DF_CELLS), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, keys, _, _ in Texts(batch.column(0), None):
                for table, at in zip(found, cells_of(keys), strict=True):
                    table += np.bincount(at, minlength=DF_CELLS)
        if n:
            flat = found.ravel()
            rows = [flat[k * width : (k + 1) * width].tobytes() for k in range(2 * SLICES)] + [np.array([n]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * SLICES + 1), pa.int32()), pa.array(rows, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    sums = {x["slice"]: np.frombuffer(x["counts"], np.int64) for x in docs.select("text").mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()}
    if not sums:
        return np.ones((2, DF_CELLS), np.float32)
    share = (np.concatenate([sums[k] for k in range(2 * SLICES)]) + 1) / (int(sums[2 * SLICES][0]) + 1)
    return (1 + np.clip(np.log(share) / np.log(RARE), 0, 1)).astype(np.float32).reshape(2, DF_CELLS)


def sketched(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, row, key, node, bands): the digest of each text's words and its band keys, null without words.

    ``row`` numbers the rows as they are read and holds for as long as the result is stored; ``key`` is as by ``common.KEY``.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, bands = [], []
        for _, _, digests, keys, weights, sizes in Texts(batch.column(3), idf.value):
            nodes += digests
            found = band_keys(samples(keys, weights, sizes, BANDS * ROWS)).tolist()
            bands += [x if n else None for x, n in zip(found, sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "key", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.expr(common.KEY).alias("key"), "text")
    return common.map_batches(rows, run, "doc_id long, row long, key binary, node binary, bands array<long>")


def _bit(node: bytes, doc_id: int | None) -> int:
    return (int.from_bytes(node[:8], "little") ^ (doc_id or 0) * 0x9E3779B1) % FILTER_BITS


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the (node, doc_id) wanted: one text of each.

    A filter of fixed size, set from all that is wanted, keeps most other texts out of the shuffle.
    """

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.array([_bit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at >> 5, pa.int64()), pa.array(np.int64(1) << (at & 31), pa.int64())], ["word", "bits"])

    words = common.map_batches(wanted.select("node", "doc_id"), bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(table)  # FILTER_BITS / 8 bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        kept, nodes = [], []
        data, off = common.utf8(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in textblock.blocks(off, 1 << 19):
            found, counts = textblock.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
            raw, at = found.tobytes(), np.concatenate([[0], np.cumsum(counts) * 8]).tolist()
            for k in range(j - i):
                node = hashlib.blake2b(raw[at[k] : at[k + 1]], digest_size=16).digest()
                b = _bit(node, ids[i + k])
                if held.value[b >> 5] >> (b & 31) & 1:
                    kept.append(i + k)
                    nodes.append(node)
        if not kept:
            return None
        some = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.binary()), some.column(1)], ["doc_id", "node", "text"])

    able = common.map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, node binary, text string")
    asked = wanted.select(F.col("node").alias("asked"), F.col("doc_id").alias("asked_id"))
    return able.join(asked, (F.col("node") == F.col("asked")) & F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi").select("node", "text").dropDuplicates(["node"])


def vectors(column: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys and weights of each text."""
    out = []
    for _, _, _, keys, weights, sizes in Texts(column, idf):
        cut = np.cumsum(sizes)[:-1]
        out += zip(np.split(keys, cut), np.split(weights, cut), strict=True)
    return out


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two texts."""
    (ka, wa), (kb, wb) = x, y
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    both = np.minimum(wa[same], wb[at[same]]).sum()
    every = wa.sum() + wb.sum() - both
    return both / every if every else 1.0


def compared(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, sim) for (a, b): the weighted Jaccard similarity of the whole texts."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = batch.column(1).to_pylist()
        firsts: dict = {}
        for k, node in enumerate(b):
            firsts.setdefault(node, k)
        right_side = dict(zip(firsts, vectors(batch.column(3).take(pa.array(list(firsts.values()), pa.int64())), idf.value), strict=True))
        sims = [likeness(x, right_side[node]) for x, node in zip(vectors(batch.column(2), idf.value), b, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return common.map_batches(rows, run, "a binary, b binary, sim double")


def shared_weights(left: list, right: list, idf: np.ndarray) -> np.ndarray:
    """What each text of ``left`` shares with each of ``right``: the lesser weights of their shingles, summed.

    A text has a shingle n times or more or it has not, so for each n that occurs it is a product
    of matrices over the shingles that both sides have so often, some at a time.
    """
    out = np.zeros((len(left), len(right)))
    keys = [np.concatenate([k for k, _ in side]) for side in (left, right)]
    names = np.intersect1d(*keys)
    if not len(names):
        return out
    weight = weight_of(names, idf).astype(float)
    sides = []
    for side, key in zip((left, right), keys, strict=True):
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        met = names[at] == key
        at = at[met]
        times = np.rint(np.concatenate([w for _, w in side])[met] / weight[at]).astype(np.int64)
        sides.append((np.repeat(np.arange(len(side)), [len(k) for k, _ in side])[met], at, times))
    low = 0
    for n in np.union1d(sides[0][2], sides[1][2]).tolist():
        sides = [[x[side[2] >= n] for x in side] for side in sides]
        often = np.intersect1d(sides[0][1], sides[1][1])
        if not len(often):
            break
        for k in range(0, len(often), COLUMNS):
            some = often[k : k + COLUMNS]
            has = []
            for (text, at, _), count in zip(sides, out.shape, strict=True):
                place = np.minimum(np.searchsorted(some, at), len(some) - 1)
                met = some[place] == at
                has.append(np.zeros((count, len(some))))
                has[-1][text[met], place[met]] = 1
            out += (has[0] * ((n - low) * weight[some])) @ has[1].T
        low = n
    return out


def spanning(left: list, right: list, labels: tuple[list, list], idf: np.ndarray) -> list[tuple[int, int]]:
    """Links between texts of different labels: as many as it takes to join all labels that links join."""
    both = shared_weights(left, right, idf)
    every = np.array([w.sum() for _, w in left])[:, None] + np.array([w.sum() for _, w in right]) - both
    sims = np.divide(both, every, out=np.ones_like(both), where=every > 0)
    numbers: dict = {}
    names = [np.array([numbers.setdefault(x, len(numbers)) for x in side]) for side in labels]
    parent = list(range(len(numbers)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    # sums in another order differ in their last digits, so what is near the threshold is taken as for one pair
    for i, j in zip(*(x.tolist() for x in np.nonzero((sims >= SIMILARITY - 1e-6) & (names[0][:, None] != names[1]))), strict=True):
        a, b = find(names[0][i]), find(names[1][j])
        if a != b and (sims[i, j] > SIMILARITY + 1e-6 or likeness(left[i], right[j]) >= SIMILARITY):
            parent[a] = b
            found.append((i, j))
    return found


def spanned(chosen: DataFrame, large: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b): links of the pivots ``chosen`` with nodes of their buckets in ``large``, enough to join all labels that these links join.

    Either side of a bucket is dealt to blocks, and each block of pivots meets each block of nodes in a task of bounded size.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("w") / BLOCK_WEIGHT)).cast("int").alias(name))

    shape = blocks(chosen, "lefts").join(blocks(large, "rights"), "key")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        whole = rows.select("key", "node", "label").join(shape, "key").join(texts, "node")
        at = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return whole.select("key", (at if own == "lefts" else met).alias("i"), (met if own == "lefts" else at).alias("j"), F.lit(own == "lefts").alias("pivot"), "node", "label", "text")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sides = [rows.filter(rows["pivot"]), rows.filter(pc.invert(rows["pivot"]))]
        nodes, labels = ([side[c].to_pylist() for side in sides] for c in ("node", "label"))
        found = []
        if all(nodes) and len({*labels[0], *labels[1]}) > 1:
            left, right = (vectors(side["text"].combine_chunks(), idf.value) for side in sides)
            found = spanning(left, right, labels, idf.value)
        common.release()
        return pa.table({"a": pa.array([nodes[0][i] for i, _ in found], pa.binary()), "b": pa.array([nodes[1][j] for _, j in found], pa.binary())})

    return dealt(chosen, "lefts", "rights").unionByName(dealt(large, "rights", "lefts")).groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def shareable(nodes: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(node, w, s): all weight of each text, and its weight in shingles that another of the nodes has too.

    What no other node has can't be shared, so the similarity of x and y is at most
    m / (w_x + w_y - m) with m = min(s_x, s_y).  Shingles are counted with partial sums
    and their counts joined back, so one that every node has is no task's burden.
    """
    some = texts.join(nodes, "node", "left_semi").select("node", "text")

    def lines(batch: pa.RecordBatch, named: bool) -> pa.RecordBatch:
        found = [(i, j, keys, weights, sizes) for i, j, _, keys, weights, sizes in Texts(batch.column(1), idf.value)]
        keys = np.concatenate([x[2] for x in found]).astype(np.int64)
        if not named:
            keys, n = np.unique(keys, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["shingle", "n"])
        owner = np.concatenate([np.repeat(np.arange(i, j), sizes) for i, j, _, _, sizes in found])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys), pa.array(np.concatenate([x[3] for x in found]).astype(float))], ["node", "shingle", "weight"])

    counts = common.map_batches(some, lambda b: lines(b, False), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    own = common.map_batches(some, lambda b: lines(b, True), "node binary, shingle long, weight double")
    both = own.join(counts.filter("n > 1").select("shingle", F.lit(1).alias("met")), "shingle", "left")
    return both.groupBy("node").agg(F.sum("weight").alias("w"), F.coalesce(F.sum(F.expr("CASE WHEN met = 1 THEN weight END")), F.lit(0.0)).alias("s"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of (a, b): the least node of each connected component.

    Least labels travel along links and then jump to the label's own label, until nothing changes.
    """
    both = common.stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        found = common.stored(own.join(jump, "now").select("node", "was", F.least("now", "far").alias("label")))
        changed = found.filter("was <> label").limit(1).count()
        common.dropped(labels)
        labels = found.select("node", "label")
        labels.stored_at = found.stored_at
        if not changed:
            common.dropped(both)
            return labels


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further (a, b): the components of the labels that these links connect, not of all links again."""
    ends = links
    for c in ("a", "b"):
        known = labels.select(F.col("node").alias(c), F.col("label").alias("now"))
        ends = ends.join(known, c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
    bridges = components(ends.filter("a <> b").select("a", "b").distinct())
    moved = bridges.select(F.col("node").alias("label"), F.col("label").alias("into"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    # ends without a label so far were components of their own
    return common.stored(old.union(bridges.join(labels, "node", "left_anti").select("node", "label")))


def linked(docs: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """(node, label) for all nodes that have a link."""
    entries = nodes.filter("bands is not null").select("node", "doc_id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    inside = common.stored(entries.join(shared, "key"))
    # the node that meets most others over all its buckets lies nearest to the middle of a group
    met = inside.groupBy("node").agg(F.sum("m").alias("met"))
    # a bucket's nodes go to as many tasks as it takes, and its pivot to each of them
    salts = F.ceil(F.col("m") / PER_SALT).cast("int")
    ranked = inside.join(met, "node").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    best = F.max(F.struct("met", "node")).alias("p")
    pivot = ranked.groupBy("key", "salt").agg(F.max("m").alias("m"), best).groupBy("key").agg(F.max("m").alias("m"), F.max("p").alias("p"))
    pivot = pivot.select("key", F.col("p.node").alias("pivot"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    members = common.stored(ranked.join(pivot, ["key", "salt"]))
    texts = common.stored(candidate_texts(docs, members.select("node", "doc_id").distinct()))
    pairs = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    done = common.stored(compared(pairs, texts, idf))
    # the other members of each bucket, with how alike they are to its pivot
    open_ = common.stored(members.filter("node <> pivot").join(done.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "sim"), ["node", "pivot"]).select("key", "node", "sim"))
    labels = components(done.filter(F.col("sim") >= SIMILARITY))
    split = open_.join(labels, "node", "left").groupBy("key").agg(F.count_distinct(F.coalesce("label", "node")).alias("parts")).filter("parts > 1").select("key")
    open_ = common.stored(open_.join(split, "key", "left_semi"))
    held = common.stored(shareable(open_.select("node").distinct(), texts, idf))
    # no partner in the bucket is lighter than its lightest node, nor than what it shares
    # a pair that shares several buckets is compared in the first of them only
    places = open_.groupBy("node").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    weighed = open_.join(held, "node").join(places, "node")
    least = weighed.groupBy("key").agg(F.min("w").alias("least"))
    able = F.col("s") >= (SIMILARITY - 1e-6) * (F.greatest("least", "s") + F.col("w") - F.col("s"))
    open_ = common.stored(weighed.join(least, "key").filter(able).drop("least"))
    pivots = PIVOTS
    while True:
        now = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parts = now.groupBy("key", "label").agg(F.count("*").alias("n"))
        spans = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("m"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("parts > 1")
        now = common.stored(now.join(spans, "key"))
        if not now.limit(1).count():
            return labels
        both = F.least("x.s", "y.s")
        near = (F.abs(F.col("x.sim") - F.col("y.sim")) <= 1 - SIMILARITY + 1e-6) & (both >= (SIMILARITY - 1e-6) * (F.col("x.w") + F.col("y.w") - both)) & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
        small = now.filter(F.col("m") <= SMALL)
        few = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & near)
        large = now.filter(F.col("m") > SMALL)
        # one node of each component first, then a second of each, and so on
        turn = F.row_number().over(Window.partitionBy("key", "label").orderBy("node"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("turn", "node"))
        # both limits hold before the shuffle too, so no task numbers all of a bucket
        chosen = large.filter("label <> main").withColumn("turn", turn).filter(F.col("turn") <= pivots).withColumn("rank", rank).filter(F.col("rank") <= pivots).select("key", "label", "node", "w")
        chosen = common.stored(chosen)
        pair = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
        fresh = few.select(pair).distinct()
        before = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        found = common.stored(compared(fresh.join(before, ["a", "b"], "left_anti"), texts, idf))
        done = common.stored(done.select("a", "b", "sim").union(found))
        # small buckets are finished, and so is each pivot in its bucket
        open_ = common.stored(large.select("key", "node", "sim", "w", "s", "keys").join(chosen.select("key", "node"), ["key", "node"], "left_anti"))
        links = common.stored(found.filter(F.col("sim") >= SIMILARITY).select("a", "b").union(spanned(chosen, large, texts, idf)))
        if links.limit(1).count():
            labels = joined_up(labels, links)
        pivots *= MORE


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the id of the row that stays), class_size, kept, key.

    The result is stored, and what was stored on the way is removed.
    """
    return common.only(lambda: _near_duplicates(docs))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))  # 2 x DF_CELLS numbers, 2 MB
    rows = common.stored(sketched(docs, idf))
    first = F.coalesce("doc_id", F.lit(-(2**63)))
    nodes = common.stored(rows.groupBy("node").agg(F.max("doc_id").alias("doc_id"), F.max_by("row", first).alias("row"), F.count("*").alias("n"), F.first("bands", ignorenulls=True).alias("bands")))
    marked = nodes.select("node", "doc_id", "row", "n").join(linked(docs, nodes, idf), "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = common.stored(marked)
    classes = marked.groupBy("label").agg(F.max("doc_id").alias("class_id"), F.max_by("row", first).alias("keep_row"), F.sum("n").alias("class_size"))
    known = marked.select("node", "label").join(classes, "label").drop("label")
    return rows.select("doc_id", "row", "key", "node").join(known, "node").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"), "key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, with all its columns; the cases are those of the module."""
    common.session(spark)
    return common.without(docs, near_duplicates(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("key")
