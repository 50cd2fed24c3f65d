"""Named queries over the driver's tables, each with the SQL that it equals where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Modules of loomwork.plans that register queries.
PLANS = ("relational", "windows", "journeys", "quality", "texts", "linkage", "series", "experiments", "recommend", "models", "streams", "sources", "tracking")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def load_all() -> None:
    for m in PLANS:
        import_module(f"loomwork.plans.{m}")
