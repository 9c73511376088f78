"""Stored indexes, versioned tables and Python sources against brute force and by hand."""

import builtins
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan

from tickloom.operators import affine, matching, materialized
from tickloom.operators import retrieval as R
from tickloom.operators import vectors as V
from tickloom.sources import polled, versioned
from tickloom.streaming import bars as S

# ---- keyword index ----


def split(text):
    text = re.sub("([一-鿿㐀-䶿豈-﫿])", r" \1 ", (text or "").lower())
    return re.findall(r"\w+", text)


def full_scores(docs, queries, k):
    """The k best (query, doc, score) by scoring every document."""
    held = {i: split(t) for i, t in docs.items() if split(t)}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(t for words in held.values() for t in set(words))
    out = []
    for q, words in queries.items():
        scores = []
        for i, own in held.items():
            tf = Counter(own)
            parts = [(1 + math.log((n + 1) / (df[t] + 1))) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in set(words) if tf[t]]
            if parts:
                scores.append((-round(sum(parts), 9), i))
        out += [(q, i, -s) for s, i in sorted(scores)[:k]]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, words in queries.items() for t in words], "query_id long, term string")


def found(spark, queries, path, k):
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in R.search(asked(spark, queries), path, k).collect())


def close(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-8)


def test_index_equals_full_scoring_after_adding_and_removing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PER_CHUNK", 40)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "слово", "naïve", "a_b"]
    docs = {k: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(1, 60))) for k in range(300)}
    docs |= {500: "比特币价格上涨", 501: "价格下跌,bitcoin价", 502: "以太坊 price", 503: None, 504: "...", 505: ""}
    queries = {1: ["w0", "w50"], 2: ["比", "特"], 3: ["价", "price"], 4: ["слово", "straße", "w1"], 5: ["nothing"], 6: ["w59", "w58", "w0", "a_b"]}
    path = str(tmp_path / "index")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    R.add(frame({k: v for k, v in docs.items() if k % 3}), path)
    R.add(frame({k: v for k, v in docs.items() if not k % 3}), path)
    close(found(spark, queries, path, 5), full_scores(docs, queries, 5))
    assert {d for q, d, _ in found(spark, queries, path, 5) if q == 2} == {500}
    gone = [k for k in docs if k % 4 == 1]
    R.remove(spark.createDataFrame([(k,) for k in [*gone, 9999]], "doc_id long"), path)
    R.remove(spark.createDataFrame([(gone[0],)], "doc_id long"), path)
    left = {k: v for k, v in docs.items() if k not in gone}
    close(found(spark, queries, path, 7), full_scores(left, queries, 7))
    # a removed document may come again with another text
    R.add(frame({gone[0]: "w59 比 price"}), path)
    close(found(spark, queries, path, 7), full_scores(left | {gone[0]: "w59 比 price"}, queries, 7))


def test_a_search_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PER_CHUNK", 20)
    rng = random.Random(7)
    docs = {k: "common " * rng.choice([1, 1, 1, 9]) + " ".join(f"x{rng.randint(0, 400)}" for _ in range(rng.randint(3, 40))) for k in range(400)}
    path, queries = str(tmp_path / "index"), {1: ["common"], 2: ["common", "x7"]}
    R.add(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), path)
    close(found(spark, queries, path, 3), full_scores(docs, queries, 3))
    blocks = spark.read.parquet(f"{path}/postings").filter("term = 'common'")
    assert blocks.count() > 10 and blocks.agg(F.max("n")).first()[0] <= 40


def test_terms_of_long_texts_cost_in_proportion(spark):
    # one regular expression a text, whatever the number of its words
    plan = spark.createDataFrame([(1, "a b")], "doc_id long, text string").select("doc_id", F.explode(R.terms("text")).alias("term"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


# ---- vectors ----


def nearest(vectors, queries, k):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    out = []
    for q in queries:
        y = np.array(queries[q]) / np.linalg.norm(queries[q])
        out += [(q, i, -s) for s, i in sorted((-round(float(y @ v), 9), i) for i, v in x.items())[:k]]
    return sorted(out)


def test_vector_store_is_exact_and_leaves_cells_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    vectors = {k: (centres[k % 12] + rng.normal(size=8) * 0.3).tolist() for k in range(600)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "vec_id long, embedding array<double>")
    path = str(tmp_path / "vectors")
    V.create(frame({k: v for k, v in vectors.items() if k < 400}), path)
    V.add(frame({k: v for k, v in vectors.items() if k >= 400} | {1000: [0.0] * 8, 1001: None}), path)
    V.remove(spark.createDataFrame([(k,) for k in range(0, 600, 5)], "vec_id long"), path)
    left = {k: v for k, v in vectors.items() if k % 5}
    queries = {k: vectors[k] for k in range(0, 600, 50)} | {2000: rng.normal(size=8).tolist()}
    near, read = V.search(frame(queries), path, 7)
    assert sorted((r.query_id, r.vec_id, r.sim) for r in near.collect()) == nearest(left, queries, 7)
    read = read.collect()
    assert len(read) == len(queries) and np.mean([r.read for r in read]) < 0.6 * read[0].cells
    # more than there are in the first cells, and all there are
    assert V.search(frame({1: vectors[1]}), path, 10_000)[0].count() == len(left)


# ---- versions ----


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges_are_published_once_and_older_versions_stay(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda data: spark.createDataFrame(data, "k long, s string, v array<struct<a:int,b:string>>")
    one = [(k, "x", [(k, "p")]) for k in range(50)] + [(None, "null", None)]
    assert versioned.merge(make(one), path, ["k"], "one") == 1
    two = [(3, "new", [(1, "q")]), (3, "twice", []), (None, "other", None), (99, "added", None)]
    assert versioned.merge(make(two), path, ["k"], "two") == 2
    assert versioned.merge(make(two), path, ["k"], "two") == 2 and len(versioned.history(spark, path)) == 2
    want = [r for r in one if r[0] not in (3, None)] + two
    assert rows(versioned.read(spark, path)) == rows(make(want))
    assert rows(versioned.read(spark, path, 1)) == rows(make(one))
    shared = [x["folders"] for x in versioned.history(spark, path)]
    assert sum(shared[0][b] == shared[1].get(b) for b in shared[0]) >= versioned.BUCKETS - 8
    gone = spark.createDataFrame([(5, True), (99, True)], "k long, gone boolean").withColumn("s", F.lit(None).cast("string")).withColumn("v", F.lit(None).cast("array<struct<a:int,b:string>>"))
    assert versioned.merge(gone, path, ["k"], "three", "gone") == 3
    assert rows(versioned.read(spark, path).select("k")) == rows(make(want).select("k").filter("k IS NULL OR k NOT IN (5, 99)"))
    assert rows(versioned.differences(spark, path, 1, 3)) == rows(spark.createDataFrame([(3, "changed"), (None, "changed"), (5, "removed")], "k long, change string"))
    with pytest.raises(ValueError):
        versioned.read(spark, path, 9)


def test_of_two_writers_one_publishes_a_version(spark, tmp_path):
    path = str(tmp_path / "table")
    entry = {"version": 1, "batch": "a", "keys": ["k"], "schema": "k:bigint", "folders": {}}
    assert versioned._publish(spark, path, entry) and not versioned._publish(spark, path, entry | {"batch": "b"})
    assert [x["batch"] for x in versioned.history(spark, path)] == ["a"]
    # the other writer takes the next one
    assert versioned.merge(spark.createDataFrame([(1,)], "k long"), path, ["k"], "b") == 2


# ---- sources ----


def bar(symbol, hours):
    return (symbol, datetime(2024, 1, 1) + timedelta(hours=hours), 1.0, 2.0, 0.5, float(hours), 10.0)


def test_polled_stream_takes_later_rows_only_across_a_restart(spark, tmp_path):
    polled.register(spark)
    path, out, state = (str(tmp_path / x) for x in ("bars", "out", "state"))

    def poll(new):
        if new:
            spark.createDataFrame(new, polled.SCHEMA).coalesce(1).write.mode("append").parquet(path)
        S.run_to(spark.readStream.format("polled_bars").option("path", path).load().select("symbol", "close"), out, state)
        return sorted(tuple(r) for r in S.result(spark, out, "symbol string, close double").collect())

    first = [bar("a", 1), bar("a", 2), bar("b", 5)]
    assert poll(first) == [("a", 1.0), ("a", 2.0), ("b", 5.0)]
    assert poll([]) == [("a", 1.0), ("a", 2.0), ("b", 5.0)]
    # a row that is not later than its symbol's last is not taken, a new symbol is
    assert poll([bar("a", 2), bar("a", 3), bar("b", 4), bar("c", 0)]) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", 0.0)]


def test_pruned_scan_reads_the_range_alone(spark, tmp_path, monkeypatch):
    polled.register(spark)
    path = str(tmp_path / "ranges")
    data = [bar(s, h) for s in ("a", "b") for h in range(24 * 60)]
    polled.write_ranges(spark.createDataFrame(data, polled.SCHEMA), path)
    low, high = datetime(2024, 1, 10), datetime(2024, 1, 10, 12)
    got = spark.read.format("pruned_bars").option("path", path).load().filter((F.col("symbol") == "a") & (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
    assert sorted(tuple(r) for r in got.collect()) == [r for r in data if r[0] == "a" and low <= r[1] < high]
    assert spark.read.format("pruned_bars").option("path", path).load().count() == len(data)

    read = {"bytes": 0, "files": 0}
    plain = builtins.open

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def seek(self, at):
            return self.f.seek(at)

        def read(self, n):
            found = self.f.read(n)
            read["bytes"] += len(found)
            return found

    def opened(name, *args, **kwargs):
        read["files"] += 1
        return Counting(plain(name, *args, **kwargs))

    reader = polled._RangeReader(path)
    assert [type(f) for f in reader.pushFilters([IsNotNull(("ts",)), EqualTo(("symbol",), "a"), GreaterThanOrEqual(("ts",), low), LessThan(("ts",), high)])] == [IsNotNull]
    parts = reader.partitions()
    monkeypatch.setattr(builtins, "open", opened)
    n = sum(b.num_rows for p in parts for b in reader.read(p))
    monkeypatch.setattr(builtins, "open", plain)
    assert n == 12 and len(parts) == read["files"] == 2
    assert read["bytes"] < 12 * polled.ROW.itemsize + 2 * polled.HEADER_SIZE + 8 * 2 * 12


# ---- affine scans and materialised features ----

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(n, symbols=("a", "b"), seed=1, hours=7):
    rng = random.Random(seed)
    out = []
    for s in symbols:
        c = 100.0
        for k in range(n):
            c = max(1.0, c + rng.gauss(0, 1)) if k % 23 else c
            out.append((s, datetime(2024, 1, 1) + timedelta(hours=hours * k), c, c + rng.random(), c - rng.random(), c, 1.0))
    return out


@pytest.mark.parametrize("name", sorted(affine.INDICATORS))
def test_blocks_do_not_change_an_indicator_and_no_python_runs(spark, name):
    bars = spark.createDataFrame(walk(600) + walk(5, ("short",)) + walk(1, ("one",)), BARS)
    one, many = (affine.INDICATORS[name](bars, n) for n in (4096, 12))
    assert not re.search("Python|Pandas|Arrow", many._jdf.queryExecution().optimizedPlan().toString())
    a, b = (sorted(map(tuple, df.collect()), key=lambda r: r[:2]) for df in (one, many))
    assert len(a) == 1206 and [r[:2] for r in a] == [r[:2] for r in b]
    for x, y in zip(a, b, strict=True):
        assert [v is None for v in x] == [v is None for v in y] and [v for v in x[2:] if v is not None] == pytest.approx([v for v in y[2:] if v is not None], rel=1e-9, abs=1e-9)


def test_averages_by_hand(spark):
    data = walk(40, ("a",))
    c = [r[5] for r in data]
    got = [r.ema10 for r in affine.ema_pair(spark.createDataFrame(data, BARS), 12).orderBy("ts").collect()]
    y, want = c[0], []
    for v in c:
        y += 2 / 11 * (v - y)
        want.append(y)
    assert got == pytest.approx(want)
    gain = loss = None
    steps = [b - a for a, b in zip(c, c[1:])]
    rsi = [r.rsi for r in affine.rsi(spark.createDataFrame(data, BARS), 12).orderBy("ts").collect()]
    assert rsi[:14] == [None] * 14
    for k in range(14, 40):
        if gain is None:
            gain, loss = sum(max(x, 0) for x in steps[:14]) / 14, sum(max(-x, 0) for x in steps[:14]) / 14
        else:
            gain, loss = (gain * 13 + max(steps[k - 1], 0)) / 14, (loss * 13 + max(-steps[k - 1], 0)) / 14
        assert rsi[k] == pytest.approx(100 - 100 / (1 + gain / loss) if loss else 100)


def test_a_refresh_reads_new_periods_only_and_equals_the_whole(spark, tmp_path):
    data = walk(500) + walk(60, ("early",)) + [(s, t + timedelta(days=90), *r) for s, t, *r in walk(30, ("late",))]
    bars = spark.createDataFrame(data, BARS)
    path, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    bars.withColumn("month", F.date_format("ts", "yyyy-MM")).write.partitionBy("month").parquet(str(tmp_path / "bars"))
    begun = []
    for until in ("2024-02-10", "2024-03-05", "2024-03-05", "2024-12-31"):
        seen = spark.read.parquet(str(tmp_path / "bars")).filter(f"ts < '{until}'")
        begun.append(materialized.refresh(seen, path, "month", per_block=50))
    assert begun == [None, "2024-02-01", "2024-03-01", "2024-03-01"]
    materialized.refresh(bars, whole, "month")
    a, b = (sorted(map(tuple, materialized.features(spark, p).collect()), key=lambda r: r[:2]) for p in (path, whole))
    assert len(a) == len(data) and [r[:2] for r in a] == [r[:2] for r in b]
    for x, y in zip(a, b, strict=True):
        assert [v is None for v in x] == [v is None for v in y] and [v for v in x[2:] if v is not None] == pytest.approx([v for v in y[2:] if v is not None])


# ---- matching ----


def two_pointers(left, right, tolerance):
    """Pairs by walking both sides of each key in order of (at, id)."""
    out = []
    for key in {r[1:3] for r in left} & {r[1:3] for r in right}:
        a, b = (sorted((r[3], r[0]) for r in side if r[1:3] == key and r[3] is not None) for side in (left, right))
        i = j = 0
        while i < len(a) and j < len(b):
            if abs(b[j][0] - a[i][0]) <= tolerance:
                out.append((a[i][1], b[j][1], b[j][0] - a[i][0]))
                i, j = i + 1, j + 1
            elif b[j][0] < a[i][0]:
                j += 1
            else:
                i += 1
    return out


@pytest.mark.parametrize(("seed", "tolerance"), [(1, 0), (2, 5), (3, 40), (4, 1000)])
def test_matching_equals_two_pointers(spark, seed, tolerance):
    rng = random.Random(seed)
    side = lambda first: [(first + k, rng.choice(["x", "y", None]), rng.choice([1, 2]), None if k % 31 == 0 else rng.choice([rng.randint(-300, 3000), 7])) for k in range(220)]
    left, right = side(0), side(1000)
    frames = [spark.createDataFrame(rows, "id long, symbol string, shares int, at long").repartition(3) for rows in (left, right)]
    got = [tuple(r) for r in matching.matched(*frames, ["symbol", "shares"], tolerance).collect()]
    pairs = [r for r in got if None not in r[:2]]
    assert sorted(pairs) == sorted(two_pointers(left, right, tolerance))
    assert sorted(r[0] for r in got if r[0] is not None) == [r[0] for r in left] and sorted(r[1] for r in got if r[1] is not None) == [r[0] for r in right]
