"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import problem_sql, problems, search_queries, search_sql


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Best documents of the example queries over an index built from the documents."""
    return search_queries.vsm_topk(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | search_queries.REGISTRY


def oracle_sql() -> dict[str, str]:
    return problem_sql.SQL | search_sql.SQL
