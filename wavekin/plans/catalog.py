"""The query catalogue of the series engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import relational_queries, series_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 5-NN through a SAX tree."""
    return series_queries.QUERIES["qry_knn_tree_sax"](spark, sf_dir)


def queries() -> dict:
    return series_queries.QUERIES | relational_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return series_queries.SQL | relational_queries.SQL
