"""All registered queries of the core library and their reference SQL."""

from __future__ import annotations

from . import analytics_queries, bar_queries, kernel_queries, ledger_queries, metric_queries, research_queries, store_queries

MODULES = [bar_queries, analytics_queries, research_queries, kernel_queries, metric_queries, ledger_queries, store_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
