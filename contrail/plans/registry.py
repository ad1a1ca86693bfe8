"""Registry of runnable queries (one per SURVEY operator) and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole derived
tables; each oracle is SQL over the driver's views (see ``plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from contrail.plans import (  # noqa: F401
        q_core, q_clean, q_joins, q_analytics, q_graph, q_live, q_ml, q_checks, q_store,
        q_moments)
