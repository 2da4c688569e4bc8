"""The registered queries outside the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import camera_queries, more_queries, pose_queries  # noqa: F401  register their queries
from .plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position errors, recalls and frame rates by sequence and method."""
    return plans.QUERIES["tracking_summary"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
