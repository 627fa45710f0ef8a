"""All named queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gridcast.catalog.views import Query, Views

MODULES = ("scans", "tables", "series", "samples", "scores", "learning")


def catalog() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        for key, query in import_module(f"gridcast.catalog.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is defined twice")
            found[key] = query
    return found


def _bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query.build(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(query) for name, query in catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.oracle for name, query in catalog().items() if query.oracle is not None}
