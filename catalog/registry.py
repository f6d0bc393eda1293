"""Collects the registered queries of all catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under `name`; without SQL only its rows are checked."""

    def wrap(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


def load() -> None:
    """Import the catalog modules, which register their queries."""
    import catalog.lines  # noqa: F401
    import catalog.texts  # noqa: F401
    import catalog.similar  # noqa: F401
    import catalog.experiments  # noqa: F401
    import catalog.audits  # noqa: F401
    import catalog.training  # noqa: F401
