"""The queries of the event pipeline and their SQL for DuckDB."""

from __future__ import annotations

from datebook.plans import block_queries, call_queries, event_queries, judge_queries, page_queries, place_queries

_ALL = {**block_queries.QUERIES, **event_queries.QUERIES, **page_queries.QUERIES, **call_queries.QUERIES, **judge_queries.QUERIES, **place_queries.QUERIES}


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
