"""Streams by symbol in slices, ratios as in SQL, chunks by slices of texts."""

import math
from datetime import datetime, timedelta

import duckdb

from tickloom.operators import documents as D
from tickloom.operators import indicators as I
from tickloom.plans import catalog
from tickloom.streaming import bars as S

BASE = datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, build):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    S.run_to(out, f"{tmp_path}/out", f"{tmp_path}/state")
    return S.result(spark, f"{tmp_path}/out", out.schema)


def test_rows_of_one_time_go_by_seq_over_several_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PER_YIELD", 3)
    rows = [("a", BASE + timedelta(hours=i // 4), float(i), i) for i in range(20)]
    got = streamed(spark, tmp_path, rows[::-1], "symbol string, ts timestamp_ntz, close double, seq long", lambda t: S.online_mean(t, 2)).collect()
    assert sorted((r.close, r.mean) for r in got if r.close) == [(float(i), i - 0.5) for i in range(1, 20)]


def test_returns_round_as_their_sql(spark, tmp_path):
    rows = [("a", BASE, 1.28, 0), ("a", BASE + timedelta(1), 100.95, 1), ("a", BASE + timedelta(2), 0.0, 2), ("a", BASE + timedelta(3), 3.0, 3)]
    got = sorted(streamed(spark, tmp_path, rows, "symbol string, ts timestamp_ntz, close double, seq long", S.online_features).selectExpr("ts", "round(ret, 6) AS ret").collect())
    assert [r.ret for r in got] == [None, 77.867187, -1.0, math.inf]


def test_a_bar_down_to_zero_has_infinite_volatility(spark):
    rows = [("a", BASE + timedelta(hours=i), 10.0 + i, 12.0 + i, 0.0 if i == 10 else 9.0 + i, 11.0 + i) for i in range(40)]
    got = I.yang_zhang(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double"), 20).orderBy("ts").collect()
    assert [math.isinf(r.yang_zhang) for r in got[20:]] == [i < 30 for i in range(20, 40)]


def test_chunks_do_not_hang_on_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "A sentence of some words. " * i if i % 5 else None) for i in range(60)], "doc_id int, text string").coalesce(1)
    whole = sorted(D.sentence_chunks(docs, 120, 30).collect())
    monkeypatch.setattr(D, "PER_SLICE", 7)
    assert whole and sorted(D.sentence_chunks(docs, 120, 30).collect()) == whole


#: Ticks of events: symbol, hour, price.  A fall and a standstill at zero, a return that is a tie at six places, nulls, NaN and a null symbol.
TICKS = [("a", 0, 3.0), ("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 5.0), ("a", 4, 160.0), ("a", 5, 66.65), ("b", 0, 1.0), ("b", 1, None), ("b", 2, 2.0), ("b", 3, None), ("b", 4, None), ("b", 5, 3.0)]
TICKS += [(s, h, 10.0 + h * h % 7) for s in ("a", "b", "c", None) for h in range(10, 40)] + [("c", 40, math.nan), ("c", 41, 7.0), ("b", 41, None), ("b", 42, 9.0)]


def test_features_at_zeros_ties_and_nulls_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", [(k, BASE + timedelta(hours=h), s, p) for k, (s, h, p) in enumerate(TICKS)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    ours, sql = catalog.queries()["stream_online_features"](spark, str(tmp_path)).collect(), con.execute(catalog.oracle_sql()["stream_online_features"]).fetchall()
    assert sorted(repr(tuple(r)) for r in ours) == sorted(map(repr, sql))
