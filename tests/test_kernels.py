import numpy as np
import pytest

from tickloom.operators import kernels as K

#: Return %, drawdown %, trades on the bars below with the first set of each strategy.
GOLDEN = {"MA": (-14.274525, 25.368108, 50), "RSI": (1.465897, 12.331057, 39), "MACD": (-22.955013, 30.340058, 113), "Drift": (-21.276268, 25.510523, 110), "RAMOM": (-22.146410, 29.079973, 66), "Turtle": (-14.586789, 21.840357, 37), "Bollinger": (-10.551377, 18.886282, 57), "Keltner": (-35.442559, 41.122848, 50), "MultiFactor": (-22.428164, 30.893294, 6), "VolRegime": (-12.973031, 19.053744, 15), "MESA": (-21.401079, 28.000324, 11), "KAMA": (-32.327403, 33.630893, 62), "Donchian": (-22.502809, 26.816676, 39), "ZScore": (7.069520, 13.268927, 33), "MomBreak": (0, 0, 0), "RegimeEMA": (6.361727, 17.326001, 18), "DualMom": (-29.263234, 31.336029, 61), "Consensus": (-27.356494, 29.610412, 10)}


def bars(n=500):
    """The draws that the frozen results were made of."""
    r = np.random.RandomState(12345)
    c = 100 * np.cumprod(1 + r.randn(n) * 0.01)
    spread = np.abs(r.randn(n) * 0.003) * c
    return K.Bars(c, c + r.randn(n) * 0.001 * c, c + spread, c - spread)


@pytest.mark.parametrize("name", K.RULES)
def test_golden(name):
    out = K.backtest(name, bars(), K.FIRST[name])
    assert (out["ret"][0], out["dd"][0], out["trades"][0]) == pytest.approx(GOLDEN[name], abs=1e-4)


def test_sets_do_not_depend_on_each_other():
    sets = [(5, 10), (3, 30), (20, 50)]
    together = K.backtest("MA", bars(), sets)["ret"]
    assert together == pytest.approx([K.backtest("MA", bars(), x)["ret"][0] for x in sets])


def walk(n, seed):
    r = np.random.default_rng(seed)
    c = 50 * np.exp(np.cumsum(r.standard_normal(n) * 0.02))
    o = c * (1 + r.standard_normal(n) * 0.003)
    return K.Bars(c, o, np.maximum(o, c) * 1.004, np.minimum(o, c) * 0.996)


def test_costs_are_what_free_trading_gains_more():
    free, dear = K.Costs(1.0, 1.0, 0.0, 1.0, 0.0), K.Costs(1.002, 0.998, 0.001, 1.0, 0.0005)
    for seed in range(4):
        b = walk(240, seed)
        for name, first in K.FIRST.items():
            a, z = (K.backtest(name, b, first, c) for c in (free, dear))
            assert a["trades"][0] or a["ret"][0] == 0
            if a["trades"][0] == z["trades"][0]:
                assert z["ret"][0] <= a["ret"][0] + 1e-9, name


def test_all_strategies_together_are_as_each_alone():
    b = walk(150, 9)
    together = K.backtest_all(b, {k: g[:7] for k, g in K.GRIDS.items()})
    for name, out in together.items():
        alone = K.backtest(name, b, K.GRIDS[name][:7])
        assert np.allclose(out["ret"], alone["ret"]) and (out["trades"] == alone["trades"]).all(), name


def test_long_bars_are_run_in_parts(monkeypatch):
    whole = K.backtest("MA", walk(150, 2), K.GRIDS["MA"])
    monkeypatch.setattr(K, "HELD", 150 * 40)
    parts = K.backtest("MA", walk(150, 2), K.GRIDS["MA"])
    assert np.allclose(whole["ret"], parts["ret"]) and len(parts["ret"]) == 355


def test_following_positions():
    b = K.Bars([10, 11, 12, 13], [10, 10, 11, 12], [11, 12, 13, 14], [9, 9, 10, 11])
    out = K.follow([0, 1, 0, 0], b, K.Costs(1.0, 1.0, 0.0, 1.0, 0.0))
    assert out["ret"][0] == pytest.approx((12 / 11 - 1) * 100) and out["trades"][0] == 1 and out["held"][:, 0].tolist() == [0, 0, 1, 0]


def test_a_strategy_without_a_rule_is_named():
    with pytest.raises(KeyError, match="Sideways"):
        K.backtest_all(walk(30, 1), {"MA": [(3, 5)], "Sideways": [(1,)]})


def test_the_grid_is_searched_in_full(spark):
    from tickloom.plans.analytics_queries import default_grid

    sizes = {"MA": 355, "RSI": 420, "MACD": 853, "Drift": 264, "RAMOM": 315, "Turtle": 420, "Bollinger": 110, "Keltner": 135, "MultiFactor": 720, "VolRegime": 288, "MESA": 9, "KAMA": 144, "Donchian": 84, "ZScore": 108, "MomBreak": 240, "RegimeEMA": 162, "DualMom": 20, "Consensus": 192}
    got = default_grid(spark).collect()
    assert {k: sum(x.strategy == k for x in got) for k in sizes} == sizes and len(got) == 4839
    assert len({(x.strategy, x.combo_id) for x in got}) == len({(x.strategy, *x.params) for x in got}) == 4839
    assert [x.params for x in got if (x.strategy, x.combo_id) in (("MA", 354), ("MACD", 852), ("Turtle", 419))] == [[95.0, 196.0], [49.0, 118.0, 45.0], [70.0, 33.0, 20.0, 3.0]]


def test_every_set_of_the_grid_has_a_finite_score_on_few_bars():
    c, o, h, l = (getattr(bars(60), k) for k in ("c", "o", "h", "l"))
    for name, sets in K.GRIDS.items():
        out = K.backtest(name, K.Bars(c, o, h, l), sets)
        assert np.isfinite(K.score(out["ret"], out["dd"], out["trades"])).all(), name
