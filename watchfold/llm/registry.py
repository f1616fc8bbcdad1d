"""Queries of this subpackage and their SQL equivalents, one per operator, and the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["simhash", "quality", "packing", "secret_scan", "mixing", "ann", "urls", "warc", "chat", "pii", "periodic", "line_index", "variants"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL equivalent when one exists."""
    def wrap(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return wrap


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"watchfold.llm.{module}")
    pipeline = importlib.import_module("corpus_pipeline")
    query("pipeline", pipeline.ORACLE_SQL)(pipeline.run)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
