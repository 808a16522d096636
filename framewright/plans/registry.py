"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}

_MODULES = (
    "signal_queries",
    "window_queries",
    "frame_queries",
    "geometry_queries",
    "raster_queries",
    "compare_queries",
    "telemetry_queries",
    "stream_queries",
    "source_queries",
    "function_queries",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is the DuckDB statement giving the same rows."""

    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        if importlib.util.find_spec(f"framewright.plans.{module}"):
            importlib.import_module(f"framewright.plans.{module}")


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
