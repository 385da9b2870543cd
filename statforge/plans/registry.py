"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


from . import aggregate_queries, evidence_queries, gate_queries, join_queries, line_queries, lineup_queries, misc_queries, payload_queries, promoter_queries, rating_queries, roster_queries, screen_queries, truth_queries, verdict_queries, window_queries  # noqa: E402, F401
