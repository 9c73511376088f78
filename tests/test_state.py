"""Streams with maps, lists and timers in their state, by hand."""

import os
import random
import string
from datetime import datetime, timedelta

import pytest

from tickloom.plans.store_queries import ingest
from tickloom.sources import versioned
from tickloom.streaming import bars as S
from tickloom.streaming import state

BASE = datetime(2024, 1, 1)


def at(hours):
    return BASE + timedelta(hours=hours)


class Feed:
    """Files that come one after another, each taken by a run of its own on one checkpoint."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.path, self.schema, self.build, self.n = spark, str(tmp_path), schema, build, 0

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/f{self.n}")
        self.n += 1
        out = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/f*"))
        S.run_to(out, f"{self.path}/out", f"{self.path}/state")
        return sorted((tuple(r) for r in S.result(self.spark, f"{self.path}/out", out.schema).collect()), key=repr)


ROWS = "symbol string, ts timestamp, interval string, pos int, close double"


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        # warm: 4h is -1, so neither side has more than half at first
        ("consensus", [(2, "4h", "buy", "open"), (3, "1h", "sell", "close"), (5, "4h", "sell", "open")]),
        # 1h may only follow 4h: at 1 it turns against it, at 3 against it, at 5 the trend itself turns
        ("trend_filter", [(2, "4h", "buy", "open"), (5, "4h", "sell", "reverse")]),
        ("primary", [(1, "1h", "buy", "open"), (3, "1h", "sell", "reverse")]),
    ],
)
def test_fusion_of_files_that_interleave_with_a_restart(spark, tmp_path, mode, want):
    warm = spark.createDataFrame([("x", "4h", -1), ("z", "1h", 1)], "symbol string, interval string, pos int")
    feed = Feed(spark, tmp_path, ROWS, lambda s: state.fused(s, ["1h", "4h"], mode, "12 hours", warm=warm))
    feed.run([("x", at(1), "1h", 1, 10.0), ("x", at(3), "1h", -1, 12.0), ("y", at(3), "1h", 0, 1.0)])
    feed.run([("x", at(2), "4h", 1, 11.0), ("x", at(5), "4h", -1, 13.0), ("x", at(4), "5m", 1, 0.0)])
    got = feed.run([("y", at(100), "1h", 0, 1.0)])
    assert [(r[1], *r[2:5]) for r in got] == sorted((int((at(h) - datetime(1970, 1, 1)).total_seconds() * 1e6), i, a, n) for h, i, a, n in want)
    with pytest.raises(ValueError):
        state.Fusion(["1h"], "other")


def test_a_silent_symbol_is_reported_by_the_others(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, ts timestamp", lambda s: state.silences(s, "2 hours"))
    us = lambda h: int((at(h) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert feed.run([("a", at(0)), ("b", at(0.5)), ("b", at(1))]) == []
    assert feed.run([("b", at(2.5))]) == [("a", us(0), "silent")]
    assert feed.run([("b", at(4))]) == [("a", us(0), "silent")]
    assert feed.run([("a", at(5)), ("b", at(5))]) == [("a", us(0), "silent"), ("a", us(5), "back")]


def test_copies_are_dropped_across_batches_until_they_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, "path string, ts timestamp, text string", lambda s: state.unseen(s, "10 hours", "1 hour").select("path", "text"))
    feed.run([("a", at(0), "one"), ("b", at(1), "two"), (None, at(0), "x"), ("n", at(0), None)])
    feed.run([("copy", at(2), "one"), ("a", at(3), "changed")])
    # the copy counts as a sight of the text, so at 11 it is still known, and at 30 no longer
    feed.run([("copy 2", at(11), "one"), ("late", at(30), "one")])
    got = feed.run([("end", at(90), "end")])
    assert got == [("a", "changed"), ("a", "one"), ("b", "two"), ("late", "one")]


def test_contents_of_one_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 1)
    feed = Feed(spark, tmp_path, "path string, ts timestamp, text string", lambda s: state.unseen(s, "10 hours").select("path", "text"))
    feed.run([(f"p{i}", at(i % 3), f"text {i % 4}") for i in range(8)] + [("end", at(30), "end")])
    got = feed.run([("again", at(31), "text 1"), ("copy", at(32), "text 1"), ("last", at(60), "last")])
    # of each text the first in order of time, and one that comes again after its time
    assert got == sorted([("p0", "text 0"), ("p1", "text 1"), ("p6", "text 2"), ("p3", "text 3"), ("again", "text 1"), ("end", "end")], key=repr)


SOURCE = "path string, ts timestamp, text string"


def size(path):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_texts_are_kept_by_the_table_and_not_by_the_state(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(versioned, "FEW", few)
    text = {k: "".join(random.Random(k).choices(string.ascii_letters, k=20_000)) for k in range(60)}
    files = [[(f"p{k}", at(0), text[k]) for k in range(40)], [("p0", at(1), text[50]), ("p0", at(1), text[50]), ("p1", at(1), text[2]), ("p3", at(2), text[51])], [("p2", at(3), text[52])], [("end", at(90), "end")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SOURCE).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
        found = state.unseen(spark.readStream.schema(SOURCE).parquet(f"{tmp_path}/in/f*"), "10 hours", texts=False)
        ingest(found, spark.read.schema(SOURCE).parquet(f"{tmp_path}/in/f*"), f"{tmp_path}/table", f"{tmp_path}/state", 20_000, 20_000)
    want = {f"p{k}": text[k] for k in range(40)} | {"p0": text[50], "p3": text[51], "p2": text[52]}
    got = versioned.read(spark, f"{tmp_path}/table").collect()
    assert sorted((r.path, r.idx, r.chunk) for r in got) == sorted((p, 0, t) for p, t in want.items())
    # neither the state nor older versions hold the texts
    whole = sum(map(len, want.values()))
    assert size(f"{tmp_path}/state") < whole / 4 and size(f"{tmp_path}/table") < whole * 1.2
