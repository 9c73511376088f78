"""Simulator, validation, documents and streams, on small hand-made cases."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import documents as D
from tickloom.operators import simulator as S
from tickloom.operators import validation as V

FREE = S.Rules(cash=1000.0, slip_bps=0.0, commission=0.0)


def bars(rows):
    return pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(days=k), *r) for k, r in enumerate(rows)], columns=["ts", "open", "high", "low", "close", "volume"])


def orders(*rows):
    return pd.DataFrame(rows, columns=["bar", "order_id", "side", "kind", "shares", "limit_price", "stop_price", "tif_bars"])


def test_a_market_order_fills_at_the_next_open():
    states, fills = S.replay("x", bars([(10, 11, 9, 10, 100), (12, 13, 11, 12, 100)]), orders((0, 1, "buy", "market", 5.0, None, None, None)), FREE)
    assert [(f[1], f[4], f[5]) for f in fills] == [(1, 5.0, 12.0)]
    assert states[-1][3:7] == (940.0, 5.0, 12.0, 1000.0)


def test_fills_stop_at_the_bars_liquidity_and_go_on():
    _, fills = S.replay("x", bars([(10, 11, 9, 10, 3)] * 4), orders((0, 1, "buy", "market", 5.0, None, None, None)), FREE)
    assert [(f[1], f[4]) for f in fills] == [(1, 3.0), (2, 2.0)]


def test_orders_expire_and_are_cancelled():
    flat = bars([(10, 11, 9, 10, 100)] * 5)
    assert S.replay("x", flat, orders((0, 1, "buy", "limit", 1.0, 5.0, None, 1)), FREE)[0][-1][-1] == 0
    both = orders((0, 1, "buy", "limit", 1.0, 5.0, None, None), (1, 1, "cancel", "market", 0.0, None, None, None))
    assert [x[-1] for x in S.replay("x", flat, both, FREE)[0]] == [1, 0, 0, 0, 0]


@pytest.mark.parametrize(("kind", "buy", "limit", "stop", "want"), [("limit", True, 9.6, None, 9.6), ("limit", True, 9.5, None, None), ("limit", False, 10.2, None, 10.2), ("stop", True, None, 10.5, 10.5), ("stop", False, None, 9.5, 9.5), ("stop", True, None, 12, None)])
def test_matching(kind, buy, limit, stop, want):
    assert S.matched(kind, buy, limit, stop, 10, 11, 9) == want


def test_a_stop_closes_at_the_next_open():
    _, fills = S.replay("x", bars([(10, 10, 10, 10, 100), (10, 10, 10, 10, 100), (8, 8, 8, 8, 100), (7, 7, 7, 7, 100)]), orders((0, 1, "buy", "market", 5.0, None, None, None)), S.Rules(cash=1000.0, slip_bps=0.0, commission=0.0, stop=0.1))
    assert [(f[1], f[3], f[5], f[7]) for f in fills] == [(1, "buy", 10.0, "order"), (3, "sell", 7.0, "stop")]


def test_splits_are_disjoint_and_cover():
    for embargo in (0, 5, 10):
        parts = V.splits(600, 6, 2, embargo)
        assert len(parts) == 15
        assert all(not set(a) & set(b) for a, b in parts)
        assert set(np.concatenate([b for _, b in parts])) == set(range(600))


def test_the_six_windows_end_with_the_last_bar():
    assert V.WINDOWS == [(0.30, 0.40, 0.50), (0.40, 0.50, 0.60), (0.50, 0.60, 0.70), (0.60, 0.70, 0.80), (0.70, 0.80, 0.90), (0.80, 0.90, 1.00)]
    assert [int(1000 * c) for _, _, c in V.WINDOWS] == [500, 600, 700, 800, 900, 1000]


def test_no_training_bar_lies_within_an_embargo_of_a_test_bar():
    for inside, outside in V.splits(600, 6, 2, 5):
        assert np.abs(inside[:, None] - outside).min() == 6
    assert list(V.splits(12, 3, 1, 1)[1][0]) == [0, 1, 2, 9, 10, 11]


def test_perturbed_runs_take_the_chosen_set_and_the_bars_it_was_not_chosen_on(spark):
    c = 100 * np.cumprod(1 + np.random.default_rng(3).standard_normal(200) * 0.02)
    x = np.column_stack([c, c * 1.01, c * 0.99, c])
    days = [pd.Timestamp("2024-01-01") + pd.Timedelta(days=k) for k in range(200)]
    rows = spark.createDataFrame([("s", t.to_pydatetime(), *map(float, r)) for t, r in zip(days, x, strict=True)], "symbol string, ts timestamp, open double, high double, low double, close double")
    sets = sorted([[40.0, 60.0], [3.0, 8.0], [5.0, 20.0]], key=lambda p: V._run("MA", x[:160], [p], V.K.Costs())["score"][0])
    grid = spark.createDataFrame([("MA", k, p) for k, p in enumerate(sets)], "strategy string, combo_id int, params array<double>")
    best = int(np.argmax(V._run("MA", x[:160], sets, V.K.Costs())["score"]))
    assert best == 2
    for method, paths in (("noise", 30), ("shuffle", 20), ("bootstrap", 20)):
        got = sorted(V.monte_carlo(rows, grid, method).collect(), key=lambda r: r.part)
        assert [(r.part, r.combo_id) for r in got] == [(k, best) for k in range(paths)]
        rng = np.random.default_rng(np.random.SeedSequence([V.SEEDS[method], 3, V.zlib.crc32(b"s")]))
        want = V._run("MA", V.METHODS[method](x[180:], rng), [sets[best]], V.K.Costs())
        assert (got[3].ret, got[3].trades) == (pytest.approx(want["ret"][0]), want["trades"][0])


def test_perturbed_bars_stay_valid():
    rng = np.random.default_rng(1)
    c = 100 * np.cumprod(1 + rng.standard_normal(200) * 0.01)
    o = c * (1 + rng.standard_normal(200) * 0.002)
    x = np.column_stack([o, np.maximum(o, c) * 1.002, np.minimum(o, c) * 0.998, c])
    for fn in V.METHODS.values():
        y = fn(x, np.random.default_rng(2))
        assert y.shape == x.shape
        assert (y[:, 1] >= y.max(1) - 1e-9).all()
        assert (y[:, 2] <= y.min(1) + 1e-9).all()
        assert (y == fn(x, np.random.default_rng(2))).all()


def test_a_chunk_begins_with_the_last_sentences():
    assert D.packed(["aaaa.", "bb.", "cc.", "dddd."], 12, 4) == ["aaaa. bb.", "bb. cc.", "cc. dddd."]
    assert D.packed([], 10, 2) == []


def test_hash_vectors_depend_on_the_text():
    a, b = D.hash_vector("a", 16), D.hash_vector("b", 16)
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-6)
    assert (a == D.hash_vector("a", 16)).all() and not (a == b).all()


def test_every_fiftieth_vector_is_searched_for_among_all(spark):
    from tickloom.plans import catalog

    assert "vector_topk" in catalog.queries()
    x = np.random.default_rng(5).integers(-2, 3, (300, 3)).astype(float)  # many equal directions
    x[7] = 0
    rows = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)] + [(300, None), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    for blocks in ({}, {"per_block": 40, "per_queries": 2}):
        got = D.nearest(rows, **blocks).collect()
        want = {}
        for q in (k for k in range(0, 300, 50) if x[k].any()):
            sims = sorted((-round(float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))), 9) + 0.0, k) for k, v in enumerate(x) if v.any())
            want |= {(q, k): -s for s, k in sims[:10]}
        assert {(r.query_id, r.vec_id): r.sim for r in got} == pytest.approx(want)


def test_stitched(spark):
    rows = [("s", "MA", 0, 10.0, 5.0, 2), ("s", "MA", 1, -20.0, 30.0, 1)]
    got = V.stitched(spark.createDataFrame(rows, "symbol string, strategy string, part int, ret double, dd double, trades long")).first()
    assert (got.ret, got.dd, got.trades) == (pytest.approx(-12.0), pytest.approx(30.0), 3)


def test_decay_follows_the_best_set_from_each_origin(spark):
    close = 100 * np.cumprod(1 + np.random.default_rng(3).normal(0, 0.02, 150))
    b = bars([(c, c * 1.01, c * 0.99, c, 1.0) for c in close]).assign(symbol="x")
    sets = [[3.0, 8.0], [4.0, 12.0], [5.0, 20.0]]
    grid = spark.createDataFrame([("MA", i, x) for i, x in enumerate(sets)], "strategy string, combo_id int, params array<double>")
    got = {(r.part, r.month): (r.combo_id, r.ret) for r in V.decay(spark.createDataFrame(b), grid, 80, 20, 15, 3).collect()}
    ohlc = b[["open", "high", "low", "close"]].to_numpy()
    want = {}
    for part, at in enumerate(range(80, 136, 20)):
        best = int(np.argmax(V._run("MA", ohlc[at - 80 : at], sets, V.K.Costs())["score"]))
        for m in (1, 2, 3):
            want[part, m] = best, V._run("MA", ohlc[at : min(at + 15 * m, 150)], [sets[best]], V.K.Costs())["ret"][0]
    assert got.keys() == want.keys()
    for k, (best, ret) in want.items():
        assert got[k] == (best, pytest.approx(ret))
    assert V.decay(spark.createDataFrame(b).limit(80), grid, 80, 20, 15, 3).count() == 0


def test_half_life_is_the_first_month_at_half(spark):
    rows = [("x", "A", p, 0, m, r) for m, rets in enumerate([(8, 0), (6, 0), (3, 1), (1, 1)], 1) for p, r in enumerate(rets)] + [("x", "B", 0, 0, 1, -1.0), ("x", "B", 0, 0, 2, -5.0)]
    got = {(r.strategy, r.month): (r.origins, r.ret, r.wins, r.half_life) for r in V.decay_table(spark.createDataFrame([(*r[:5], float(r[5])) for r in rows], V.DECAY)).collect()}
    assert got[("A", 1)] == (2, 4.0, 0.5, 3) and got[("A", 3)] == (2, 2.0, 1.0, 3) and got[("B", 2)] == (1, -5.0, 0.0, None)
