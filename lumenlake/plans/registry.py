"""Registered queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenlake.plans.views import Library, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Library], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function Library -> DataFrame; `sql` is the same query for the check engine."""

    def add(run: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, with_views(views, sql) if sql else None)
        return run

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q.run(Library(spark, sf_dir))

    return {name: bind(q) for name, q in QUERIES.items()}


def check_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
