"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sensorloom.plans.queries import evaluation, fusion, heads, ingest, pulse, study, subjects, windows
from sensorloom.sources.package import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (ingest, windows, pulse, subjects, heads, fusion, evaluation, study)


def _with_package(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def registered() -> dict[str, tuple[Query, str | None]]:
    """``{name: (callable(spark, folder), sql or None)}``."""
    result: dict[str, tuple[Query, str | None]] = {}
    for module in _MODULES:
        for name, (query, sql) in module.QUERIES.items():
            if name in result:
                raise ValueError(f"Query {name} is registered twice.")
            result[name] = (_with_package(query), sql)
    return result
