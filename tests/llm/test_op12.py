"""The graph search against all pairs: overlapping cells, dense groups, copies, hostile rows, recall."""

import os

import numpy as np
import pytest

from tickloom import shuffles
from tickloom.llm import common
from tickloom.llm import op12_embeddings as op

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string, `a.b` string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "clash", "dot") for i, v, label in rows], schema).repartition(3)


def plain(rows):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    able = []
    for _, v, label in rows:
        x = None
        if label is not None and v is not None and len(v) and None not in list(v):
            x = np.array(v, np.float32).astype(float)
            x = x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None
        able.append(x)
    n = len(rows)
    near = [[k for k in range(n) if k != i and able[i] is not None and able[k] is not None and rows[i][2] == rows[k][2] and len(able[i]) == len(able[k]) and able[i] @ able[k] >= 0.98] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        if group[i] == i:
            todo = [i]
            while todo:
                for m in near[todo.pop()]:
                    if group[m] != i:
                        group[m] = i
                        todo.append(m)
    least = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(k), least.get(g), i == least.get(g)) for (i, _, _), k, g in zip(rows, near, group, strict=True)), key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def groups(rng, size, lone, groups, noise, label=1):
    """Random vectors, and groups of near copies of some."""
    out = list(rng.normal(size=(lone, size)))
    for n in groups:
        base = rng.normal(size=size)
        out += [base + noise * rng.normal(size=size) for _ in range(n)]
    return [(v, label) for v in out]


def numbered(rng, vectors):
    order = rng.permutation(len(vectors))
    return [(k, *vectors[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("size", "noise"), [(64, 0.08), (16, 0.1), (3, 0.02)])
def test_equals_all_pairs(spark, size, noise):
    rng = np.random.default_rng(size)
    rows = numbered(rng, groups(rng, size, 300, [2, 3, 40, 60], noise, 1) + groups(rng, size, 100, [2, 2, 2], noise, 2))
    assert got(op.near_duplicates(frame(spark, rows))) == plain(rows)


def test_overlapping_shards(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_SHARD", 150)
    rng = np.random.default_rng(5)
    rows = numbered(rng, groups(rng, 64, 500, [2] * 60 + [5] * 10 + [30, 70], 0.1))
    want = plain(rows)
    mine = got(op.near_duplicates(frame(spark, rows)))
    links = sum(r[1] for r in want)
    assert [r[0] for r in mine] == [r[0] for r in want] and 0.99 * links <= sum(r[1] for r in mine) <= links
    assert sum(a != b for a, b in zip(mine, want, strict=True)) <= 8


def test_dense_group_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_SHARD", 60)
    rng = np.random.default_rng(6)
    rows = numbered(rng, groups(rng, 24, 20, [400], 0.06))
    assert got(op.near_duplicates(frame(spark, rows))) == plain(rows)


def test_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        *((k, v, 1) for k in (10, 11, 12)), (12, v, 1), (None, v, 1), (9, [2.0, 4.0, 6.0], 1), (13, v, 2), (14, v, None), (15, None, 1), (16, [], 1),
        (17, [0.0, 0.0, 0.0], 1), (18, [1.0, None, 3.0], 1), (19, [1.0, nan, 3.0], 1), (20, [1.0, inf, 3.0], 1), (21, [1.0, 2.0], 1), (22, [-1.0, -2.0, -3.0], 1),
        (23, [0.0, 1.0], 3), (24, [-0.0, 1.0], 3), (None, [1.0, 0.0], 4), (None, [1.0, 0.0], 4), (25, [1e30, 2e30, 3e30], 1), (26, [1e-40, 2e-40, 3e-40], 5),
    ]
    assert got(op.near_duplicates(frame(spark, rows))) == plain(rows)
    assert got(op.near_duplicates(frame(spark, []))) == []
    doubles = frame(spark, [(1, [1e-200, 0.0], 1), (2, [1e200, 1e190], 1)], SCHEMA.replace("float", "double"))
    assert got(op.near_duplicates(doubles)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_pruning_keeps_what_is_not_covered():
    x = op.unit(np.array([[1, 0, 0], [1, 0.1, 0], [1, 0.12, 0], [1, 0, 0.2], [0, 0, 1]], float))
    wide = np.vstack([x, np.zeros((1, 3))])
    kept = op.pruned(wide, np.array([0]), np.array([[1, 2, 3, 4, 5, 5]]), 4)[0]
    assert set(kept[kept < 5]) == {1, 3, 4}


def test_recall_is_audited(spark):
    rng = np.random.default_rng(9)
    rows = numbered(rng, groups(rng, 32, 300, [50, 50, 2, 2], 0.08))
    df = frame(spark, rows)
    truth, found = op.audited(df, op.near_duplicates(df))
    assert truth == sum(r[1] for r in plain(rows) if r[0] % 50 == 0) and found >= 0.9 * truth > 0


def test_an_edge_that_two_shards_made_is_one(spark):
    """Lists of several shards name the same neighbour; it is met, and counted, once."""
    x = op.unit(np.random.default_rng(3).normal(size=(40, 16)) * 0.05 + 1)
    ids = np.arange(40) * 3
    lists = op.built(x.astype(np.float32), ids)
    own, near = np.repeat(np.arange(40), [len(v) for v in lists]), np.concatenate(lists)
    graph = op.Graph(ids, x, own, near, np.tile(own, 2), np.tile(ids[near], 2), np.zeros(2 * len(own)))
    who, at, _ = graph.within(graph.x[:40], graph.near[:40], graph.exact)
    assert len(who) and len({*zip(who.tolist(), at.tolist(), strict=True)}) == len(who)


def test_far_neighbours_stay_in_their_shard(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_SHARD", 100)
    x = np.random.default_rng(4).normal(size=(600, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    held = []
    adjacency = op.adjacency
    monkeypatch.setattr(op, "adjacency", lambda *a: held.append(adjacency(*a).selectExpr("sum(length(near)) AS away", "sum(length(places)) AS own").first()) or adjacency(*a))
    assert op.near_duplicates(vectors).count() == 600
    assert held[0].own > 600 * 2 * 10 and held[0].away < held[0].own / 10


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for top in disk.localDirs() for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(shuffles.CLEANUP, None)
    out = common.stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert files() <= before and spark.conf.get(shuffles.CLEANUP, None) == setting
    assert out.count() == 7
