"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline.plans import context_queries, match_queries, more_queries, record_queries, report_queries, zone_queries, zone_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return zone_queries.QUERIES | match_queries.QUERIES | more_queries.QUERIES | context_queries.QUERIES | record_queries.QUERIES | report_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return zone_sql.ORACLES | match_queries.ORACLES | more_queries.ORACLES | context_queries.ORACLES | record_queries.ORACLES | report_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_queries.radar_top(spark, sf_dir)
