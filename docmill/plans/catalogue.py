"""All queries of the reference's operators over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.plans import analytics_queries, rank_queries, record_queries, text_queries  # noqa: F401  they register their queries
from docmill.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search with a metadata filter."""
    return rank_queries.vector_topk_filtered(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
