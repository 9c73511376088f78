"""The draw against a plain one: features, gains and ranks; runs, ranges and levels of merging; hostile rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import common
from tickloom.llm import op11_resampling as op

DOCS = "doc_id long, text string, row long, n_words long, score string, `a.b` string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, longest=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, longest=1):
    """Rows (doc_id, n_features, weight, score, rank) as the contract says, in the order of docs."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    have = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    want = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    s, t = sum(have.values()) + 10000, sum(want.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log(((want[b] + 1) * s) / ((have[b] + 1) * t)))
    rows = []
    for i, (doc_id, text) in enumerate(docs):
        n, own = features(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, i])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def frames(spark, docs, target):
    d = spark.createDataFrame([(i, t, 1, 2, "clash", "dot") for i, t in docs], DOCS).repartition(5)
    return d, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Straße", "naïve", "日本語", "x y", "ÄÖ", "a-b", "C3PO", "_", " "]
    docs = [(k * 7 % (2 * n), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(n)]
    return docs, [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)]


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_the_plain_draw(spark, longest):
    docs, target = corpus(400)
    docs += [(None, None), (-5, ""), (10**6, "q" * 5000 + " Long " * 3000), (10**6 + 1, "---"), (10**6 + 2, "\x00a\x00")]
    d, t = frames(spark, docs, target + [None, ""])
    assert got(op.resampled(d, t, longest)) == Counter(plain(docs, target, longest))


def test_runs_ranges_and_levels(spark, monkeypatch):
    for name, value in (("PER_RANGE", 20), ("BLOCK", 3), ("FAN", 2), ("PERCENT", 10)):
        monkeypatch.setattr(op, name, value)
    docs, target = corpus(1500, 4)
    d, t = frames(spark, docs, target)
    assert got(op.resampled(d, t)) == Counter(plain(docs, target))


def test_ties_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_RANGE", 30)
    monkeypatch.setattr(op, "BLOCK", 4)
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(5, text)] * 200 + [(None, text)] * 200 + [(k, text) for k in range(100, 300)]
    d, t = frames(spark, docs, ["w1 w2"])
    assert got(op.resampled(d, t)) == Counter(plain(docs, ["w1 w2"]))


def test_empty_tables_and_too_few_words(spark):
    d, t = frames(spark, [], ["a b"])
    assert op.resampled(d, t).collect() == []
    docs = [(k, "word " * k) for k in range(25)]
    d, t = frames(spark, docs, [])
    assert got(op.resampled(d, t)) == Counter(plain(docs, []))
    assert not any(r.rank for r in op.resampled(d, t).collect())


def test_checksums_of_words_of_any_length():
    rng = random.Random(1)
    ws = ["".join(rng.choices("abcXYZ019éü", k=n)) for n in (1, 2, 7, 47, 48, 49, 200, 70_000) for _ in range(5)]
    data, off = common.utf8(pa.array([" ".join(ws[:20]), None, "", "a", ",".join(ws[20:])]))
    found, owner, n = op.buckets(data, off)
    want = [zlib.crc32(lowered(w).encode()) % 10000 for w in [*ws[:20], "a", *ws[20:]]]
    assert found.tolist() == want and n.tolist() == [20, 0, 0, 1, 20]
    assert owner.tolist() == [0] * 20 + [3] + [4] * 20


@pytest.mark.parametrize("seed", range(5))
def test_tournament_merges_runs(seed):
    rng = np.random.default_rng(seed)
    rows = np.zeros((500, 6), np.int64)
    rows[:, 0], rows[:, 1], rows[:, 2] = rng.integers(0, 20, 500), rng.integers(0, 9, 500), np.arange(500)
    key = lambda r: (-r[0], r[1], r[2])
    blocks = []
    for run in range(1 + seed * 3):
        own = np.array(sorted(rows[rows[:, 2] % (1 + seed * 3) == run].tolist(), key=key))
        blocks += [(own[i].tolist(), run, own[i : i + 7].tobytes()) for i in range(0, len(own), 7)]
    blocks.sort(key=lambda b: key(b[0]))
    assert list(op.merged(iter([b[1:] for b in blocks]))) == sorted(rows.tolist(), key=key)
    assert list(op.merged(iter([]))) == []
