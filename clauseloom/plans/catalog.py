"""The registry of named queries: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clauseloom.plans import corpora
from clauseloom.sources.adapters import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables)``; ``uses`` names the corpora the SQL builds on."""

    def add(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        full = None if sql is None else corpora.with_corpora(sql, uses.split())
        CATALOG[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), full)
        return fn

    return add
