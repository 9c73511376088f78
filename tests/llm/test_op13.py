"""The overlap join against all pairs: lists nested at will, hostile rows, hot keys dealt to several shards."""

import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tickloom.llm import op13_intervals as op

BASE = datetime(2024, 1, 1)


def relation(a, b, s, e):
    names = [["overlapped_by", "finishes", "during"], ["started_by", "equals", "starts"], ["contains", "finished_by", "overlaps"]]
    return names[0 if a > s else 1 if a == s else 2][0 if b > e else 1 if b == e else 2]


def by_pairs(queries, intervals):
    """{(id, relation): [number, shared or None, total]} by comparing every query with every interval of its key."""
    out = defaultdict(lambda: [0, None, 0])
    for i, k, a, b, n in queries:
        for kk, s, e, m, t in intervals:
            if k is not None and k == kk and a is not None and s is not None and a <= b and s <= e and a <= e and s <= b:
                x = out[i, relation(a, b, s, e)]
                x[0] += n * m
                x[2] += n * t
                if not (b == e == op.OPEN):
                    x[1] = (x[1] or 0) + n * m * (min(b, e) - max(a, s) + 1)
    return dict(out)


@pytest.mark.parametrize("seed", range(12))
def test_lists_nested_at_will(seed):
    rng = np.random.default_rng(seed)
    n, span = int(rng.integers(0, 60)), int(rng.integers(3, 60))
    s = rng.integers(-20, span, n)
    e = s + rng.integers(0, span, n) * rng.integers(0, 2, n)
    e[rng.random(n) < 0.2] = op.OPEN
    m, t = rng.integers(1, 4, n), rng.integers(0, 1000, n)
    base = np.full(n, op._HALF)
    lists = op.Lists(s + base, e + base, m, t, base)
    a = rng.integers(-25, span + 5, 80)
    b = a + rng.integers(0, span, 80)
    b[rng.random(80) < 0.2] = op.OPEN
    got = lists.related(a + op._HALF, b + op._HALF, np.full(80, op._HALF))
    want = by_pairs([(i, 0, int(x), int(y), 1) for i, (x, y) in enumerate(zip(a, b))], [(0, *map(int, x)) for x in zip(s, e, m, t)])
    seen = {(i, op.RELATIONS[k]): got[i, k].tolist() for i, k in zip(*np.nonzero(got[:, :, 0]))}
    assert seen == {k: [v[0], v[1] or 0, v[2]] for k, v in want.items()}


def test_depth_follows_containment_and_open_ones_share_a_list():
    s, e = np.array([0, 1, 2, 3, 9, 4, 12]), np.array([op.OPEN, 8, 7, 5, op.OPEN, op.OPEN, 13])
    base = np.full(7, op._HALF)
    lists = op.Lists(s + base, e + base, np.ones(7, int), np.ones(7, int), base)
    assert [(x.first - op._HALF).tolist() for x in lists.levels] == [[0, 4, 9], [1, 12], [2], [3]]


def frames(spark, queries, intervals):
    q = spark.createDataFrame(queries, "id long, key long, first long, last long, n long")
    return q, spark.createDataFrame(intervals, "key long, first long, last long, n long, total long")


def found(df):
    return {(r.id, r.relation): [r.n_pairs, r.shared, r.total] for r in df.collect()}


@pytest.mark.parametrize("per_shard", [50_000, 40])
def test_hot_key_and_null_keys(spark, monkeypatch, per_shard):
    monkeypatch.setattr(op, "PER_SHARD", per_shard)
    rng = np.random.default_rng(per_shard)
    queries, intervals = [], []
    for i in range(400):
        k = None if i % 17 == 0 else 7 if i % 3 else int(rng.integers(0, 30))
        a = int(rng.integers(0, 50))
        queries.append((i // 2, k, a, op.OPEN if i % 5 == 0 else a + int(rng.integers(-1, 20)), 1 + i % 2))
    for i in range(300):
        s = int(rng.integers(0, 50))
        intervals.append((None if i % 19 == 0 else 7 if i % 3 else int(rng.integers(0, 40)), s, op.OPEN if i % 7 == 0 else s + int(rng.integers(-1, 9)), 1, i))
    q, m = frames(spark, queries, intervals)
    assert found(op.related(q, m, len(queries))) == by_pairs(queries, intervals)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, key long, n long, shard int"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, first long, last long"
LINES = "sale_id long, line_no int, shipped_at timestamp_ntz, id long"


def whole(spark, tmp_path, clicks, sales, lines):
    for name, rows, schema in (("clicks", clicks, CLICKS), ("sales", sales, SALES), ("sale_lines", lines, LINES)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return {(r.sale_id, r.relation): [r.n_pairs, r.overlap_slots, r.sessions_crc] for r in op.query(spark, str(tmp_path)).collect()}


def click(i, minutes, client, kind="view"):
    return (i, None if minutes is None else BASE + timedelta(minutes=minutes), None, client, kind, None, "x" * 50, 1, 1, 1)


def test_sessions_by_hand(spark, tmp_path):
    hours = 60.0
    clicks = [
        *(click(0, 0, 1), click(1, 15, 1), click(1, 15, 1)),  # 15 minutes apart: one session, slot 0
        *(click(2, 30.01, 1), click(3, 7 * hours, 1)),  # two sessions: slot 0, slot 1
        *(click(4, 13 * hours, 1, "error"), click(5, 13 * hours, 1, None)),  # open, from slot 2
        *(click(6, None, 1), click(7, 5, None), click(8, -1, 2, "error"), click(9, 0, 2), click(10, 20 * hours, 2, None)),
    ]
    day = lambda d: BASE + timedelta(days=d)
    sales = [(1, 1, "done", day(0), 0, 0), (2, 1, "open", day(0), 0, 0), (3, None, "done", day(0), 0, 0), (4, 1, "done", None, 0, 0), (5, 2, None, day(0), 0, 0), (5, 2, None, day(0), 0, 0), (6, 99, "done", day(0), 0, 0)]
    lines = [(1, 1, day(0.25), 5), (1, 1, day(0.2), 5), (1, 2, None, 5), (None, 1, day(9), 5), (5, 1, day(-3), 5)]
    crc = lambda *minutes: sum(zlib.crc32(str(round(x * 60e6) + 1704067200_000_000).encode()) for x in minutes)
    assert whole(spark, tmp_path, clicks, sales, lines) == {
        (1, "started_by"): [2, 2, crc(0, 30.01)],
        (1, "finished_by"): [1, 1, crc(420)],
        (2, "started_by"): [2, 2, crc(0, 30.01)],
        (2, "contains"): [1, 1, crc(420)],
        (2, "finished_by"): [1, None, crc(780)],
        (5, "finishes"): [2, 2, 2 * crc(-1)],
    }


def test_empty_tables(spark, tmp_path):
    assert whole(spark, tmp_path / "a", [], [], []) == {}
    assert whole(spark, tmp_path / "b", [click(0, 0, 1)], [], []) == {}
    assert whole(spark, tmp_path / "c", [], [(1, 1, "done", BASE, 0, 0)], []) == {}


@pytest.mark.parametrize("seed", range(2))
def test_sessions_equal_a_walk_over_the_clicks(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for client in range(6):
        at = -3000.0  # minutes: sessions over midnight and, of the last client, over days; clicks exactly 15 minutes apart
        for k in range(400):
            at += float(rng.choice([0, 1, 14.9, 15, 15.0001, 300, 1440], p=[0.1, 0.3, 0.35 - 0.1 * (client % 3), 0.1 + 0.1 * (client % 3), 0.05, 0.06, 0.04]))
            at = -3000 + 14.9 * k if client == 5 else at
            rows.append(click(k, at, client, "error" if rng.random() < 0.3 else "view"))
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    want = []
    for client in range(6):
        own = sorted((us(r[1]), r[4] == "error") for r in rows if r[3] == client)
        held = [own[0]]
        for x in [*own[1:], (10**18, False)]:
            if x[0] - held[-1][0] > op.GAP:
                want.append((client, held[0][0], held[-1][0], any(e for t, e in held if t == held[-1][0])))
                held = []
            held.append(x)
    got = op.sessions(spark.createDataFrame(rows, CLICKS)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(e - b > 2 * 86400 * 10**6 for _, b, e, _ in want)
