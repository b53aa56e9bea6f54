"""All queries over the driver tables, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import documents, lookups, more, scalars, snapshots, sweeps, variants, wordings
from lexmill.plans.registry import ORACLES, QUERIES, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.c01_topic_coverage(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["documents", "flagship", "lookups", "more", "oracle_sql", "queries", "scalars", "snapshots", "sweeps", "variants", "wordings"]
