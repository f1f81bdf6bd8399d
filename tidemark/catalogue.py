"""All queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import archive_queries, city_queries, event_queries, lifecycle_queries, misc_queries, step_queries, topic_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entities with most valid, unique events."""
    return event_queries.o1(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
