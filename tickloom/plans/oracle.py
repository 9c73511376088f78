"""Common parts of the reference SQL."""

TICKS = "SELECT event_type AS symbol, ts, value AS price, 1.0 AS size, event_id AS seq FROM events"


def bars_cte(every: str = "4 hours", name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{every}', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, (ts, seq)) AS close, sum(size)::DOUBLE AS volume FROM ({TICKS}) t GROUP BY 1, 2)"""


DAILY = """daily AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
      min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""
TRADES = """trades AS (SELECT l_returnflag AS symbol, CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS shares, l_extendedprice / l_quantity AS price,
      l_tax * l_extendedprice AS commission, l_shipdate AS ts, l_orderkey AS ok, l_linenumber AS ln FROM lineitem)"""
W = "w AS (PARTITION BY symbol ORDER BY ts)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def windowed(expressions: str, base: str = "bars", ctes: str | None = None) -> str:
    return f"WITH {ctes or bars_cte()} SELECT symbol, ts, {expressions} FROM {base} WINDOW {W}"
