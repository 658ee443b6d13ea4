"""The base tables and the silver entities as DataFrames, and the registration of operators over them.

An operator is a function of a :class:`Net`.  Beside it stands its answer as SQL for another engine, written apart from
it over the same entities (:mod:`tideway.sources.silver`), which are put in front of that SQL as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideway import catalog
from tideway.sources.silver import ENTITIES

TABLES = (
    "region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages",
    "benchmark", "labels", "conversations", "embeddings",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expanded(sql: str) -> str:
    """The query with the entities that it uses, and those that they use, in front."""
    used: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in ENTITIES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(ENTITIES[name])
                used.append(name)

    need(sql)
    ctes = ",\n".join(f"{n} AS ({ENTITIES[n]})" for n in used)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not ctes:
        return sql
    recursive = "RECURSIVE " if own and own[1] else ""
    return f"WITH {recursive}{ctes}" + (f",\n{sql[own.end():]}" if own else f"\n{sql}")


class Net:
    """Base tables and silver entities of one folder by name: ``net.orders``, ``net.segments``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read(self.spark, self.sf_dir, name)
        if name not in ENTITIES:
            raise AttributeError(name)
        text = expanded(f"SELECT * FROM {name}").replace("{", "{{").replace("}", "}}")
        # Tables come as arguments, so no view of the session is created or replaced.
        text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text)
        used = {t: read(self.spark, self.sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)


def operator(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Net], DataFrame]], Callable[[Net], DataFrame]]:
    """Register a function of a Net under ``name`` or its own name, with the other engine's SQL if there is one."""

    def registered(make: Callable[[Net], DataFrame]) -> Callable[[Net], DataFrame]:
        catalog.register(name or make.__name__, lambda spark, sf_dir: make(Net(spark, sf_dir)), expanded(sql) if sql else None)
        return make

    return registered
