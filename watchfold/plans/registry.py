"""All registered queries, collected from the per-area plan modules."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ["auth", "sources", "drives", "topology", "pairs", "groups", "evaluation", "vision", "knowledge", "review", "models", "streams"]

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL equivalent when one exists."""
    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return wrap


def _load() -> None:
    for area in AREAS:
        if importlib.util.find_spec(f"watchfold.plans.{area}") is None:
            continue
        importlib.import_module(f"watchfold.plans.{area}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
