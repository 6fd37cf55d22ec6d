"""Registry of queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, language_queries, storage_queries


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly sums of a day's clicks, from text to DataFrame."""
    return language_queries.engine(spark, folder).sql("SELECT sum(value) FROM events WHERE time >= '2024-01-05' AND time < '2024-01-06' AND event_type = 'click' GROUP BY TIME(1h) FILL(none)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return language_queries.queries() | storage_queries.queries() | data_queries.queries()


def oracle_sql() -> dict[str, str]:
    return language_queries.oracle_sql() | storage_queries.oracle_sql() | data_queries.oracle_sql()
