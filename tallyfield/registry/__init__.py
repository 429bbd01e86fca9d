"""Named queries over the given tables, each with comparison SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COMPARISONS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` must give the same rows and column names."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            COMPARISONS[name] = sql.strip()
        return function

    return add


def load_all() -> None:
    from tallyfield.registry import cleaning, elements, history, keys, loads, models, reports, sources  # noqa: F401
