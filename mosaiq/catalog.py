"""The queries of the file-content operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.plans import registry

FLAGSHIP = registry.FLAGSHIP


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in registry.all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in registry.all_queries().items() if q.sql is not None}
