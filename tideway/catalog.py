"""The registry of the library's own queries: each module adds (name, query, SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "provider_risk"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Add a query; names are unique."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


MODULES = (
    "functions.geo",
    "functions.scalars",
    "functions.text",
    "operators.filters",
    "operators.joins",
    "operators.aggregates",
    "operators.ordering",
    "operators.graph",
    "operators.news",
    "plans.scoring",
    "plans.recommend",
    "plans.audit",
    "streaming.ais",
    "sources.files",
)


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"tideway.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
