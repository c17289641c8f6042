"""The two dictionaries that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditspark.workload.tables import shown, sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, **extra: str) -> Callable[[Query], Query]:
    """Register a query and, if it can be written, the same query as SQL."""
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shown(run(spark, sf_dir))
        if body is not None:
            SQL[name] = sql(body, **extra)
        return run

    return add
