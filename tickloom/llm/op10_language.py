"""Language identification: script ranges, scores by word, and Viterbi over each text.

A word is a run of letters, and of marks such as vowel signs, with a letter in
it; both are told by their Unicode category.  Its score in a language is the
sum of the log probabilities of its byte trigrams.  The scripts of its code
points narrow the languages that can claim it to those whose training texts use
such a script.  Viterbi with a penalty for each switch then labels the words, so
a text of mixed language falls into spans.

All texts of a batch are decoded together.  Texts are cut into chunks of at
least ``CHUNK`` words; the best score between any entry and exit language of a
chunk is found for all chunks at once, the chunks of a text are then joined in
order, and the labels within all chunks are traced back at once.  This is
exact, and a text of any length costs array operations, not a loop by word.

The model is fitted on a bounded sample: ``PER_LANGUAGE`` documents of a language,
about, copies once; every language of the training documents is learned.  The
trigrams are hashed into fewer cells the more languages there are, so that the
model stays within ``NUMBERS`` up to 4,096 languages and grows by 16 kB for each
further one.  Every document is labelled.

With more than ``FEW`` languages the texts of a block are decoded side by side,
word by word, which costs the languages and not their square; a text whose scores
would not fit into memory is decoded by itself, a slice of its words at a time.

Defined results: null texts and texts without a letter are ``und`` with score
0; without training documents every text is ``und``; a null id is not held out;
ties go to the language that comes first by code point; repeated rows get equal
labels; texts of any length are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblock

#: Documents of a language that the model learns from at most, about.
PER_LANGUAGE = 3000
#: Numbers of the model, and the most and the least cells of a language.
NUMBERS, CELLS, LEAST_CELLS = 1 << 24, 1 << 16, 1 << 12
#: Languages up to which chunks of a text are decoded side by side, by the square of the languages.
FEW = 24
#: Scores that are held at once beyond that.
SCORES = 1 << 23
CHUNK = 64
#: What a switch of language costs, in nats.
PENALTY = 12.0
UNKNOWN = "und"
SEED = 10
#: A language uses a script if this share of its letters is of it.
SCRIPT_SHARE = 0.02
_NEVER = np.float32(-1e4)

#: First code points of ranges, and the script of the letters from there on.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0xFF65, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_BITS = np.array([1 << SCRIPTS.index(s) for _, s in RANGES], np.int32)
#: Stands with the script of letters, not with that of marks.
_LETTER = np.int32(1 << 30)
_kinds: np.ndarray | None = None


def _of_code_point() -> np.ndarray:
    """For each code point: 0, or the bit of its script if it is a mark, and ``_LETTER`` besides if it is a letter."""
    global _kinds
    if _kinds is None:
        kind = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode()
        kind = np.frombuffer(kind, np.uint8)
        letter = kind == ord("L")
        script = _BITS[np.searchsorted(_STARTS, np.arange(0x110000), "right") - 1]
        _kinds = np.where(letter | (kind == ord("M")), script, 0).astype(np.int32) | np.where(letter, _LETTER, 0).astype(np.int32)
    return _kinds


_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Words:
    """The words of some texts: where their bytes are, their scripts, and how many each text has."""

    cells: np.ndarray  # trigram cell of each byte of a word, flat
    starts: np.ndarray  # where each word's cells begin
    begin: np.ndarray  # byte of the text block at which each word begins
    sizes: np.ndarray  # bytes of each word
    scripts: np.ndarray
    counts: np.ndarray  # words of each text


def _scripts(data: np.ndarray) -> np.ndarray:
    """What each byte's code point is, as by ``_of_code_point``; later bytes have that of the first."""
    kinds = _of_code_point()
    out = kinds[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b = [padded[lead + k] for k in range(4)]
    size = np.where(b[0] >= 0xF0, 4, np.where(b[0] >= 0xE0, 3, 2))
    tail = [x & 0x3F for x in b]
    code = np.where(size == 2, (b[0] & 0x1F) << 6 | tail[1], np.where(size == 3, (b[0] & 0xF) << 12 | tail[1] << 6 | tail[2], (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
    bits = kinds[np.minimum(code, 0x10FFFF)]
    out[data >= 0x80] = 0
    for k in range(4):
        on = size > k
        out[(lead + k)[on]] = bits[on]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n, m = len(data), len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return Words(none, none, none, none, none.astype(np.int32), np.zeros(m, np.int64))
    bits = _scripts(data)
    inside = bits != 0
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(inside & ~after) + 1
    if len(starts):
        # a run of marks alone is no word
        held = np.maximum.reduceat(bits, starts) >= _LETTER
        if not held.all():
            alone = np.zeros(n + 1, np.int32)
            alone[starts[~held]] += 1
            alone[ends[~held]] -= 1
            inside &= np.cumsum(alone[:-1]) == 0
            starts, ends = starts[held], ends[held]
    # each byte with the one before and the one after, blanks outside the word
    code = _FOLD[data].astype(np.int64)
    left = np.concatenate([[0], code[:-1]]) * before
    right = np.concatenate([code[1:], [0]]) * after
    hashed = (left << 16 | code << 8 | right) * 0x9E3779B1 >> 12 & CELLS - 1  # a model of fewer cells takes the lower bits
    sizes = ends - starts
    flat = hashed[inside]
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else none
    scripts = np.bitwise_or.reduceat(bits[inside], at) & ~_LETTER if len(at) else none.astype(np.int32)
    return Words(flat, at, starts, sizes, scripts, np.diff(np.searchsorted(starts, offsets)))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # cells x languages
    scripts: np.ndarray  # a mask for each language

    def scores(self, w: Words, first: int = 0, last: int | None = None) -> np.ndarray:
        """Words ``first`` to ``last`` by languages; languages without a script of the word are out, unless all are."""
        last = len(w.starts) if last is None else last
        out = np.zeros((last - first, len(self.languages)), np.float32)
        if first == last:
            return out
        step = max(1, SCORES // max(1, len(self.languages)) // 8)  # words average fewer bytes
        for i in range(first, last, step):
            j = min(i + step, last)
            low = w.starts[i]
            high = w.starts[j] if j < len(w.starts) else len(w.cells)
            out[i - first : j - first] = np.add.reduceat(self.logs[w.cells[low:high] & len(self.logs) - 1], w.starts[i:j] - low, axis=0)
        out -= out.max(1, keepdims=True)
        able = (w.scripts[first:last, None] & self.scripts[None, :]) != 0
        out[~able] = _NEVER
        out[~able.any(1)] = 0
        return out

    def labels(self, w: Words) -> np.ndarray:
        """The best label of each word of each text."""
        many = len(self.languages)
        if many <= FEW:
            return viterbi(self.scores(w), w.counts)
        first = np.concatenate([[0], np.cumsum(w.counts)])
        step = max(1, SCORES // many)
        out, i = np.zeros(int(first[-1]), np.int64), 0
        while i < len(w.counts):
            # as many texts as fit, or slices of one that does not
            j = max(i + 1, int(np.searchsorted(first, first[i] + step, "right")) - 1)
            a, b = int(first[i]), int(first[j])
            cuts = range(a, b, step) if j == i + 1 else [a]
            parts = (self.scores(w, k, min(k + step, b) if j == i + 1 else b) for k in cuts)
            out[a:b] = side_by_side(parts, w.counts[i:j], many)
            i = j
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word, text by text, where each change of label costs ``penalty``."""
    n, languages = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    counts = counts[used]
    # what stands for a chunk has the square of the languages, so it grows with them
    size = max(CHUNK, languages * languages // 4)
    chunks = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(chunks)])
    total = int(first[-1])
    within = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    chunk, place = np.repeat(first[:-1], counts) + within // size, within % size
    steps = int(min(size, counts.max()))
    # only the last chunk of a text is short; its rest scores nothing and so changes no label before it
    s = np.zeros((steps, languages, total), np.float32)
    s[place, :, chunk] = scores
    across = np.full((languages, languages, total), -np.inf, np.float32)  # label, entry
    across[np.arange(languages), np.arange(languages)] = 0
    for t in range(steps):
        top = across.max(0)
        np.maximum(across, top - np.float32(penalty), out=across)
        across += s[t][:, None, :]
    best = np.zeros((languages, len(used)), np.float64)
    came = np.zeros((languages, total), np.int64)
    order = np.argsort(-chunks, kind="stable")
    deep = chunks[order]
    for k in range(int(deep[0])):
        docs = order[: int(np.searchsorted(-deep, -k, "left"))]
        at = first[docs] + k
        way = best[None][:, :, docs] + across[:, :, at]
        came[:, at] = way.argmax(1)
        best[:, docs] = way.max(1)
        best[:, docs] -= best[:, docs].max(0)
    leave = np.zeros(total, np.int64)
    enter = np.zeros(total, np.int64)
    now = best.argmax(0)
    for k in range(int(deep[0]) - 1, -1, -1):
        docs = order[: int(np.searchsorted(-deep, -k, "left"))]
        at = first[docs] + k
        leave[at] = now[docs]
        now[docs] = enter[at] = came[now[docs], at]
    value = np.full((languages, total), -np.inf, np.float32)
    value[enter, np.arange(total)] = 0
    stay, top_label = np.empty((steps, languages, total), bool), np.empty((steps, total), np.int64)
    for t in range(steps):
        top_label[t] = value.argmax(0)
        changed = value.max(0) - np.float32(penalty)
        stay[t] = value >= changed
        value = np.maximum(value, changed) + s[t]
    labels = np.empty((steps, total), np.int64)
    now, every = leave, np.arange(total)
    for t in range(steps - 1, -1, -1):
        labels[t] = now
        now = np.where(stay[t][now, every], now, top_label[t])
    return labels[place, chunk]


def side_by_side(parts: Iterator[np.ndarray], counts: np.ndarray, languages: int, penalty: float = PENALTY) -> np.ndarray:
    """The labels of ``viterbi``, a word of every text at a time; the scores of a single text may come in several parts."""
    total = int(counts.sum())
    stay = np.zeros((total, -(-languages // 8)), np.uint8)
    top = np.zeros(total, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    deep = counts[order]
    value = np.zeros((len(order), languages), np.float32)
    done = 0
    for scores in parts:
        longest = len(scores) if len(order) == 1 else int(deep.max(initial=0))
        for t in range(longest):
            m = int(np.searchsorted(-deep, -(done + t), "left"))
            at = first[order[:m]] + done + t
            now = value[:m]
            top[at] = now.argmax(1)
            changed = now.max(1, keepdims=True) - np.float32(penalty)
            stay[at] = np.packbits(now >= changed, axis=1)
            now = np.maximum(now, changed) + scores[at - done if len(order) == 1 else at]
            value[:m] = now - now.max(1, keepdims=True)
        done += longest if len(order) == 1 else 0
    labels, now = np.zeros(total, np.int64), value.argmax(1)
    for t in range(int(deep.max(initial=0)) - 1, -1, -1):
        m = int(np.searchsorted(-deep, -t, "left"))
        at = first[order[:m]] + t
        labels[at] = now[:m]
        kept = stay[at, now[:m] >> 3] >> (7 - (now[:m] & 7)) & 1
        now[:m] = np.where(kept == 1, now[:m], top[at])
    return labels


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    """Trigram scores and scripts of each language, from the documents that are not held out."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False))).select(F.col("lang").cast("string"), "text")
    sums = {x["lang"]: x["n"] for x in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language, as the model has
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0, np.int32))
    n_cells = CELLS
    while n_cells > LEAST_CELLS and n_cells * len(languages) > NUMBERS:
        n_cells >>= 1
    scale = 1 << 30
    rates = docs.sparkSession.createDataFrame([(k, int(scale * min(1.0, PER_LANGUAGE / sums[k]))) for k in languages], "known string, rate long")
    draw = F.xxhash64(F.lit(SEED), "text")
    some = able.withColumn("draw", draw).join(F.broadcast(rates), F.col("lang") == F.col("known")).filter(F.pmod("draw", F.lit(scale)) <= F.col("rate"))
    # copies of a text are one text to learn from
    some = some.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    number = {k: i for i, k in enumerate(languages)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = common.utf8(batch.column(1))
        lang = np.array([number[x] for x in batch.column(0).to_pylist()])
        keys, n = [], []
        for i, j in textblock.blocks(off):
            w = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            own = np.repeat(lang[i:j], w.counts)
            a, b = np.unique(np.repeat(own, w.sizes) * n_cells + (w.cells & n_cells - 1), return_counts=True)
            # cells below n_cells * languages are trigrams, those above are bytes of each script
            c = [(own * 32 + k, np.where(w.scripts >> k & 1, w.sizes, 0)) for k in range(len(SCRIPTS))]
            script = np.bincount(np.concatenate([x for x, _ in c]), np.concatenate([y for _, y in c]), minlength=32 * len(languages)).astype(np.int64)
            keys += [a, n_cells * len(languages) + np.flatnonzero(script)]
            n += [b, script[script > 0]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["cell", "n"])

    found = common.map_batches(some.select("lang", "text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    size = n_cells * len(languages)
    counts = np.zeros(size + 32 * len(languages))
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    grams = counts[:size].reshape(len(languages), n_cells) + 0.5
    logs = np.log(grams / grams.sum(1, keepdims=True)).T
    script = counts[size:].reshape(len(languages), 32)
    used = script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)
    masks = (used[:, : len(SCRIPTS)] * (1 << np.arange(len(SCRIPTS)))).sum(1)
    return Model(languages, np.ascontiguousarray(logs, np.float32), masks.astype(np.int32))


def _labelled(model: Model, column: pa.Array):
    """For each block of texts: first and last number, its words and their labels."""
    data, off = common.utf8(column)
    for i, j in textblock.blocks(off):
        w = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, w, off[i : j + 1] - off[i], model.labels(w) if model.languages else None


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans): the language with most letters of each text, and its share of them."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # NUMBERS at most, 64 MB, up to 4,096 languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        k = len(m.languages)
        names, scores, spans = [], [], []
        for i, j, w, _, labels in _labelled(m, batch.column(2)):
            if labels is None:
                names, scores, spans = names + [UNKNOWN] * (j - i), scores + [0.0] * (j - i), spans + [0] * (j - i)
                continue
            owner = np.repeat(np.arange(j - i), w.counts)
            share = np.bincount(owner * k + labels, w.sizes, minlength=(j - i) * k).reshape(j - i, k)
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
            spans += np.bincount(owner[new], minlength=j - i).tolist()
            top, total = share.argmax(1), share.sum(1)
            names += [m.languages[x] if n else UNKNOWN for x, n in zip(top, w.counts, strict=True)]
            scores += (share.max(1) / np.maximum(total, 1)).tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64()), pa.array(spans, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return common.map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, first_byte, end_byte): runs of words of one language, in order, as bytes of the UTF-8 text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        ids, out = batch.column(0).to_pylist(), []
        for i, j, w, off, labels in _labelled(m, batch.column(1)):
            if labels is None or not len(labels):
                continue
            owner = np.repeat(np.arange(j - i), w.counts)
            new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])]))
            last = np.append(new[1:], len(labels)) - 1
            for a, b in zip(new, last, strict=True):
                out.append((ids[i + owner[a]], m.languages[labels[a]], int(w.begin[a] - off[owner[a]]), int(w.begin[b] + w.sizes[b] - off[owner[a]])))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "lang", "first_byte", "end_byte"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang string, first_byte long, end_byte long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
