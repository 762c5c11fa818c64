"""Registry of named queries; modules of mosaiq.plans add theirs with @query."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "thumbnail_geometry"
MODULES = ("geometry", "sniff", "sheets", "rasters", "documents", "pictures", "decoders", "small")
_FOUND: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with the DuckDB SQL of its rows."""

    def add(run):
        _FOUND[name] = Query(run, sql)
        return run

    return add


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"mosaiq.plans.{module}")
    return dict(_FOUND)
