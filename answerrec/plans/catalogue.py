"""Registry of named queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; without `sql` only its rows are checked."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add
