"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rodfield.plans import base_queries, graph_queries, series_queries, store_queries, structure_queries

MODULES = [base_queries, graph_queries, series_queries, structure_queries, store_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean nematic order by state, with its confidence radius over replicas."""
    return base_queries.nematic(spark, sf_dir)
