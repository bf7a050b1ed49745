"""Registry of named queries over the driver's tables, each with an optional oracle SQL text.

A query is ``f(spark, sf_dir) -> DataFrame``. Its oracle is ANSI SQL (DuckDB dialect) over the
same parquet tables; queries whose result depends on a trained model or a random draw register
no oracle and are checked by property tests instead.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import q_text, q_sample, q_bandit, q_stats, q_topics, q_model  # noqa: F401
