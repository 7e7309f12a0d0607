"""The registry that ``__spark_entry__`` serves; modules add to it with ``query``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("search", "text", "relational", "events", "graphs", "vectors", "search_more", "stores", "scoring", "streams", "links", "inventory", "web")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with DuckDB SQL for its rows if SQL can express them."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def sql(name: str) -> str:
    """The SQL of a query that is registered already, for others to build on."""
    return _SQL[name]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"trawl.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
