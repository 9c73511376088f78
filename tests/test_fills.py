"""Fills within a tolerance and their summary against their SQL, on lines with nulls, parts of shares and seconds, and zeros."""

import duckdb
import pytest

from tickloom.plans import catalog

#: Lines of lineitem: order, line, quantity, extended price, time.
CASES = {
    "nulls": "(1, 1, 10, 100, '2000-01-01'), (1, 1, NULL, 100, '2000-01-01'), (2, 1, 5, 55, NULL), (2, 1, 5, 56, '2000-01-01'), (3, NULL, 5, 55, '2000-01-01'), (3, 2, 5, 155, '2000-01-01')",
    "parts of shares": "(1, 2, 2.5, 100, '2000-01-01'), (1, 1, 2, 90, '2000-01-01'), (2, 2, 2.6, 100, '2000-01-01'), (2, 1, 3, 90, '2000-01-01'), (3, 2, -2.5, 100, '2000-01-01'), (3, 1, -2, 90, '2000-01-01')",
    "parts of seconds": "(1, 2, 2, 100, '2000-01-01 00:00:00.9'), (1, 1, 2, 90, '2000-01-01 00:00:00.2'), (2, 2, 2, 100, '2000-01-01 00:02:30.2'), (2, 1, 2, 90, '1999-12-31 23:59:59.9'), (3, 2, 2, 91, '1969-12-31 23:59:00.1'), (3, 1, 2, 90, '1969-12-31 23:59:29.9')",
}
ZEROS = "(1, 1, 2, 90, '2000-01-01'), (1, 2, 0, 10, '2000-01-01'), (1, 3, 2, 0, '2000-01-01'), (2, 1, 2, 90, '2000-01-01'), (2, 2, 2, '-0.0', '2000-01-01'), (3, 1, 0, 0, '2000-01-01'), (4, 1, 0, -5, '2000-01-01')"


def lines(path, values):
    duckdb.execute(f"""COPY (SELECT ok::BIGINT AS l_orderkey, ln::INTEGER AS l_linenumber, q::DOUBLE AS l_quantity, e::DOUBLE AS l_extendedprice, 0.02::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, ts::TIMESTAMP AS l_shipdate
      FROM (VALUES {values}) t(ok, ln, q, e, ts)) TO '{path}/lineitem.parquet'""")
    return str(path)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/lineitem.parquet')")
    return [sorted(repr(tuple(r)) for r in x) for x in (catalog.queries()[name](spark, path).collect(), con.execute(catalog.oracle_sql()[name]).fetchall())]


@pytest.mark.parametrize("name", ["divergence_summary", "fills_tolerance"])
@pytest.mark.parametrize("case", CASES)
def test_fills_equal_their_sql(spark, tmp_path, case, name):
    ours, sql = both(spark, lines(tmp_path, CASES[case]), name)
    assert ours == sql


def test_rows_that_the_sql_leaves_open_are_settled_by_their_values(spark, tmp_path):
    tied = [f"(1, 1, 2, {price}, '2000-01-01')" for price in (90, 100, 110, 120)]
    found = set()
    for k in range(4):
        (tmp_path / str(k)).mkdir()
        found.add(tuple(catalog.queries()["fills_tolerance"](spark, lines(tmp_path / str(k), ", ".join(tied[k:] + tied[:k]))).first()))
    assert len(found) == 1


@pytest.mark.parametrize("name", ["divergence_summary", "fills_tolerance", "fill_costs", "latest_per_key", "order_rounding"])
def test_prices_of_zero_shares_are_those_of_sql(spark, tmp_path, name):
    ours, sql = both(spark, lines(tmp_path, ZEROS), name)
    assert ours == sql


def test_of_rows_that_the_sql_leaves_open_the_nearest_price_is_taken(spark, tmp_path):
    path = lines(tmp_path, "(1, 1, 2, 90, '2000-01-01'), (1, 1, 2, 100, '2000-01-01'), (1, 1, 2, 120, '2000-01-01')")
    assert [tuple(r) for r in catalog.queries()["fills_tolerance"](spark, path).collect()] == [(1, 1, True, 5.0, 30)]
