"""All core queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vanthu.plans import general, inventory, pipeline, searching, services

MODULES = [searching, pipeline, inventory, general, services]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_hybrid_search"](spark, sf_dir)
