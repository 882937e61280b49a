"""All queries of the library with their SQL counterparts."""

from __future__ import annotations

from verdance.plans import index_queries, object_queries, space_queries, surface_queries, table_queries

_PARTS = (table_queries, space_queries, object_queries, surface_queries, index_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
