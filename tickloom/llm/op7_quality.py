"""Quality classifier without labels: a weak-label model and a hashed linear scorer.

Heuristic labellers vote bad, nothing or good on each whole text.  What the
labellers say about all documents is a count for each pattern of votes, of
which there are at most 3 ** labellers, however many documents.  Expectation-
maximisation over those counts estimates how each labeller votes on good and
on bad documents, and so the posterior of each pattern.  A bounded sample of
documents, with their posteriors as soft labels, trains a linear scorer over
hashed words, pairs of byte classes and hashed levels of the text's figures.
The scorer, a vector of fixed length, then scores every whole document.

Defined results: null texts count as empty; texts on which no labeller votes
have the prior as posterior, and an empty text is scored by its levels alone;
where no pattern of votes, or every one, has a posterior below one half there is
nothing to tell apart, and everything is kept, be it clean or junk; repeated
rows get equal scores; a null or repeated id changes nothing, as the score is
one of the text alone; an empty table gives no rows.  The query reads no other
columns; the stage passes them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblock

#: Distinct texts of either kind that train the scorer, at most, and the bytes of these together.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 25
#: A kind weighs in training as if it were at least this share of the sample, and else as much as the other.
LEAST_SHARE = 0.02
#: Hashed features.
DIMENSIONS = 1 << 18
#: A document stays from this score on.
KEEP = 0.5
SEED = 77

LABELLERS = ("symbols", "symbol_words", "capitals", "shouting", "repeated_passages", "repeated_words", "word_length")
BAD, NONE, GOOD = 0, 1, 2

_CLASS = np.full(256, 11, np.int16)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[32], _CLASS[10], _CLASS[ord(".")], _CLASS[ord(",")], _CLASS[ord("!")], _CLASS[ord("?")] = 3, 4, 5, 6, 7, 8
_CLASS[[ord(c) for c in "\"'-();:"]] = 9
_CLASS[[ord(c) for c in "#$%&*@^~|<>{}[]\\/=+_`"]] = 10
_CLASS[128:] = 12
_KINDS = 13


@dataclass
class Block:
    """Words, shingles and byte classes of some texts."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Block:
        words, counts = textblock.word_hashes(data, offsets)
        return cls(words, counts, _CLASS[data], offsets)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), np.diff(self.offsets))

    def histogram(self) -> np.ndarray:
        """Bytes of each class, by text."""
        n = len(self.counts)
        return np.bincount(self.owners() * _KINDS + self.classes, minlength=n * _KINDS).reshape(n, _KINDS)

    def figures(self) -> np.ndarray:
        """By text: share of symbols, runs of them to a word, shares of capitals, exclamation marks, repeated passages and words; mean word length; words."""
        n, h = len(self.counts), self.histogram().astype(float)
        size = np.maximum(h.sum(1), 1)
        letters = np.maximum(h[:, 0] + h[:, 1] + h[:, 12], 1)
        shingles, sizes = textblock.shingles(self.words, self.counts, 5)
        _, _, distinct = textblock.counted(shingles, sizes)
        owner = np.repeat(np.arange(n), self.counts)
        same = np.zeros(n)
        if len(self.words) > 1:
            again = (self.words[1:] == self.words[:-1]) & (owner[1:] == owner[:-1])
            same = np.bincount(owner[1:][again], minlength=n)
        words = np.maximum(self.counts, 1)
        symbol = self.classes == 10
        begins = symbol & ~np.concatenate([[False], symbol[:-1]])
        runs = np.bincount(self.owners()[begins], minlength=n)
        return np.stack([h[:, 10] / size, runs / words, h[:, 1] / letters, h[:, 7] / size, 1 - distinct / np.maximum(sizes, 1), same / words, (size - h[:, 3] - h[:, 4]) / words, self.counts], 1)


def votes(figures: np.ndarray) -> np.ndarray:
    """The labellers' votes, a column each; they abstain on texts too short to tell and between their limits."""
    symbols, runs, capitals, shouting, passages, repeats, length, words = figures.T
    some, more = words >= 5, words >= 20

    def vote(value: np.ndarray, good: float, bad: float, able: np.ndarray) -> np.ndarray:
        return np.where(able & (value >= bad), BAD, np.where(able & (value <= good), GOOD, NONE))

    return np.stack([
        vote(symbols, 0.003, 0.03, some),
        vote(runs, 0.02, 0.15, some),
        vote(capitals, 0.08, 0.35, some),
        vote(shouting, 0.002, 0.03, some),
        vote(passages, 0.02, 0.25, more),
        vote(repeats, 0.02, 0.2, some),
        vote(np.abs(length - 5.2), 0.9, 2.0, more),
    ], 1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def fit(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over (pattern: documents).

    Returns the share of good documents, table[class, labeller] = the share of its
    votes that say good, and the posterior of good for each pattern.  An abstention
    says nothing.  It starts from the votes, of which one for bad counts as much as
    four for good, as most labellers know one kind of bad text only.
    """
    k = len(LABELLERS)
    keys = sorted(counts)
    n = np.array([counts[x] for x in keys], float)
    v = np.array([[x // 3**j % 3 for j in range(k)] for x in keys]).reshape(-1, k)
    bad, good = v == BAD, v == GOOD
    post = np.clip((good.sum(1) + 4) / (good.sum(1) + 6 * bad.sum(1) + 4.5), 0.02, 0.98)
    prior, table = 0.5, np.full((2, k), 0.5)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        table = (weight @ good + 1.0) / (weight @ (good | bad) + 2.0)
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        logs = np.log([1 - prior, prior])[:, None] + np.log(table) @ good.T + np.log(1 - table) @ bad.T
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return prior, table, dict(zip(keys, post.tolist(), strict=True))


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: (index, value) flat, and how many each text has.

    Words weigh the root of their count, to length 1 together; pairs of byte
    classes weigh four times their share; each level of a figure weighs 1.
    """
    n = len(block.counts)
    cells, tf, per = textblock.counted(block.words, block.counts)
    word_at = (cells >> np.uint64(30)).astype(np.int64) % (DIMENSIONS - 1024) + 1024
    owner = np.repeat(np.arange(n), per)
    value = np.sqrt(tf)
    length = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = value / np.maximum(length[owner], 1e-9)
    byte_owner = block.owners()
    pair_owner = byte_owner[1:][byte_owner[1:] == byte_owner[:-1]] if len(byte_owner) > 1 else byte_owner[:0]
    pair = (block.classes[:-1] * _KINDS + block.classes[1:])[byte_owner[1:] == byte_owner[:-1]] if len(byte_owner) > 1 else byte_owner[:0]
    pairs = np.bincount(pair_owner * 169 + pair, minlength=n * 169).reshape(n, 169)
    rows, at = np.nonzero(pairs)
    share = 4.0 * pairs[rows, at] / np.maximum(pairs.sum(1), 1)[rows]
    figures = block.figures()
    levels = np.stack([np.digitize(figures[:, j], edges) for j, edges in enumerate(([0.003, 0.01, 0.03, 0.1], [0.02, 0.05, 0.15, 0.5], [0.05, 0.1, 0.35, 0.7], [0.002, 0.01, 0.03, 0.1], [0.02, 0.1, 0.25, 0.5], [0.02, 0.1, 0.2, 0.5], [3.2, 4.3, 6.1, 7.2], [1, 5, 20, 100]))], 1)
    level_at = 512 + np.arange(levels.shape[1]) * 8 + levels
    all_owner = np.concatenate([owner, rows, np.repeat(np.arange(n), levels.shape[1])])
    all_at = np.concatenate([word_at, at, level_at.ravel()])
    all_value = np.concatenate([value, share, np.ones(level_at.size)])
    order = np.argsort(all_owner, kind="stable")
    return all_at[order], all_value[order].astype(np.float32), np.bincount(all_owner, minlength=n)


def _blocks(column: pa.Array):
    data, off = common.utf8(column)
    for i, j in textblock.blocks(off, 1 << 18):
        yield i, j, Block.of(data[off[i] : off[j]], off[i : j + 1] - off[i])


def voted(docs: DataFrame) -> DataFrame:
    """(draw, bytes, pattern) of every document: a hash of its text, its size and its pattern of votes; stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([pattern(votes(b.figures())) for _, _, b in _blocks(batch.column(2))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["draw", "bytes", "pattern"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.lit(SEED), text).alias("draw"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))
    return common.stored(common.map_batches(rows, run, "draw long, bytes long, pattern long"))


def train(at: list[np.ndarray], value: list[np.ndarray], target: np.ndarray, epochs: int = 120) -> np.ndarray:
    """Logistic regression on soft targets by full gradients with per-weight steps; the last weight is the bias."""
    weights, seen = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    if not len(target):
        return weights
    flat, val = np.concatenate(at), np.concatenate(value).astype(float)
    owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
    # a kind of which there is next to nothing does not outweigh what there is
    good = np.maximum(target.sum(), LEAST_SHARE * len(target))
    bad = np.maximum((1 - target).sum(), LEAST_SHARE * len(target))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[flat] * val, minlength=len(at)) + weights[-1], -30, 30)))
        # otherwise the two kinds weigh the same together
        residual = target * (p - 1) / good + (1 - target) * p / bad
        grad = np.bincount(flat, residual[owner] * val, minlength=DIMENSIONS + 1)
        grad[-1] = residual.sum()
        grad[:-1] += 1e-4 * weights[:-1]
        seen += grad * grad
        weights -= 0.5 * grad / (np.sqrt(seen) + 1e-8)
    return weights


def keep_all() -> np.ndarray:
    """Weights that keep every text."""
    weights = np.zeros(DIMENSIONS + 1)
    weights[-1] = 5.0
    return weights


def scorer(docs: DataFrame) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and what the weak-label model says of its labellers."""
    seen = voted(docs)
    counts = {x["pattern"]: x["n"] for x in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** labellers at most
    if not counts:
        return np.zeros(DIMENSIONS + 1), {}
    prior, table, post = fit(counts)
    kinds = [[k for k in counts if (post[k] >= 0.5) == good] for good in (True, False)]
    facts = {"prior": prior, "table": table, "patterns": counts, "sampled": 0}
    if not all(kinds):
        common.dropped(seen)
        return keep_all(), facts
    scale = 1 << 30
    chosen: dict[int, float] = {}
    for kind in kinds:
        # more than are wanted are drawn, so that those with the least draws are among them
        rate = min(1.0, 2 * SAMPLE / sum(counts[k] for k in kind))
        place = F.pmod("draw", F.lit(scale))
        some = seen.filter(F.col("pattern").isin(kind) & (F.col("bytes") <= SAMPLE_BYTES) & (place < int(rate * scale) + 1)).groupBy("draw").agg(F.first("pattern").alias("pattern"), F.first("bytes").alias("bytes"))
        left = SAMPLE_BYTES
        for x in some.orderBy(place, "draw").limit(SAMPLE).collect():
            if x["bytes"] <= left:
                chosen[x["draw"]] = post[x["pattern"]]
                left -= x["bytes"]
    common.dropped(seen)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "wanted long"))  # 2 x SAMPLE at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws = batch.column(1).to_numpy(zero_copy_only=False)
        once = np.sort(np.unique(draws, return_index=True)[1])
        at, value = [], []
        for i, j, block in _blocks(batch.column(0).take(pa.array(once))):
            where, val, per = features(block)
            first = np.concatenate(([0], np.cumsum(per)))
            at += [where[first[d] : first[d + 1]].astype(np.int32).tobytes() for d in range(j - i)]
            value += [val[first[d] : first[d + 1]].tobytes() for d in range(j - i)]
        return pa.RecordBatch.from_arrays([pa.array(draws[once]), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["draw", "at", "value"])

    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(text.alias("text"), F.xxhash64(F.lit(SEED), text).alias("draw")).join(wanted, F.col("draw") == F.col("wanted"), "left_semi")
    drawn = common.map_batches(dealt, run, "draw long, at binary, value binary").groupBy("draw").agg(F.first("at").alias("at"), F.first("value").alias("value"))
    # the texts behind these are of 2 x SAMPLE_BYTES at most
    found = sorted(((x["draw"], x["at"], x["value"]) for x in drawn.collect()), key=lambda x: x[0])
    weights = train([np.frombuffer(x[1], np.int32) for x in found], [np.frombuffer(x[2], np.float32) for x in found], np.array([chosen[x[0]] for x in found]))
    return weights, facts | {"sampled": len(found)}


def _judge(weights: np.ndarray, column: pa.Array) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of texts and their scores."""
    for _, _, block in _blocks(column):
        at, value, per = features(block)
        total = np.bincount(np.repeat(np.arange(len(per)), per), weights[at] * value, minlength=len(per)) + weights[-1]
        yield block, 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, kept, votes) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # DIMENSIONS + 1 numbers, 1 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, said = [], []
        for block, own in _judge(held.value, batch.column(1)):
            score.append(own)
            said += ["".join("-0+"[x] for x in row) for row in votes(block.figures())]
        score = np.concatenate(score)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= KEEP), pa.array(said)], ["doc_id", "score", "kept", "votes"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, kept boolean, votes string")


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows whose text the scorer keeps, with all their columns, judged where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.concatenate([own for _, own in _judge(held.value, batch.column(text))])
        return batch.filter(pa.array(score >= KEEP))

    # names of any kind pass, as places stand for them meanwhile
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return common.map_batches(plain, run, plain.schema).toDF(*docs.columns)


def classify(docs: DataFrame) -> DataFrame:
    return scored(docs, scorer(docs)[0])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the scorer keeps, row by row, with all their columns; the cases are those of the module."""
    common.session(spark)
    return accepted(docs, scorer(docs)[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))
