"""Orders of bars: by hand, across batches, and after failures between the two tables."""

import pytest

from tickloom.sources import versioned
from tickloom.streaming import handler

RULES = handler.Rules(capital=1000.0, share=0.5, slippage=0.01, commission=0.1, band=0.0)
#: (at, close, fast average, slow average, rsi)
BARS = [(1, 10.0, 2.0, 1.0, None), (2, 10.0, 2.0, 1.0, 50.0), (3, 12.0, 2.0, 1.0, 50.0), (4, 20.0, 1.0, 2.0, 50.0), (5, 25.0, 1.0, 1.0, 50.0), (6, 600.0, 2.0, 1.0, 50.0), (7, 10.0, 2.0, 1.0, 50.0)]
WANT = [
    (2, "buy", "open", 50, 10.1, 50.5, 0.0),
    (4, "sell", "reverse", 75, 19.8, 148.5, 485.0),
    (5, "buy", "close", 25, 25.25, 63.125, -136.25),
    (7, "buy", "open", 50, 10.1, 50.5, 0.0),
]


def _frame(spark, bars=BARS, symbol="s"):
    return spark.createDataFrame([(symbol, *b) for b in bars], "symbol string, at long, close double, ema10 double, ema20 double, rsi double")


def _journal(spark, path):
    rows = versioned.read(spark, f"{path}/journal").orderBy("symbol", "at").collect()
    return [(r.at, r.action, r.intent, r.shares, pytest.approx(r.price), pytest.approx(r.commission), pytest.approx(r.pnl)) for r in rows]


@pytest.mark.parametrize("cuts", [[], [1, 2, 3, 4, 5, 6], [4]])
def test_batches_change_nothing(spark, tmp_path, cuts):
    path = str(tmp_path / "t")
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(BARS)], strict=True)):
        handler.handle(_frame(spark, BARS[a:b]), n, path, RULES)
    assert _journal(spark, path) == WANT


def test_a_batch_that_is_run_again_after_a_failure(spark, tmp_path, monkeypatch):
    path, whole = str(tmp_path / "t"), versioned.merge
    handler.handle(_frame(spark, BARS[:3]), 0, path, RULES)

    def broken(rows, to, *args):
        if to.endswith("held"):
            raise OSError("lost")
        return whole(rows, to, *args)

    monkeypatch.setattr(versioned, "merge", broken)
    with pytest.raises(OSError, match="lost"):
        handler.handle(_frame(spark, BARS[3:5]), 1, path, RULES)
    monkeypatch.setattr(versioned, "merge", whole)
    for number, rows in ((1, BARS[3:5]), (1, BARS[3:5]), (2, BARS[5:])):
        handler.handle(_frame(spark, rows), number, path, RULES)
    assert _journal(spark, path) == WANT


def test_rows_without_price_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    handler.handle(_frame(spark, []), 0, path, RULES)
    handler.handle(_frame(spark, [(1, None, 2.0, 1.0, 50.0), (2, 0.0, 2.0, 1.0, 50.0), (3, 10.0, 2.0, 1.0, 50.0)]), 1, path, RULES)
    assert [r[0] for r in _journal(spark, path)] == [3]
