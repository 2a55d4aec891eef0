"""Series in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_delimited(lines: DataFrame, col: str, delimiter: str = r"\s+") -> DataFrame:
    """Adds ``values`` from a delimiter-separated column."""
    return lines.withColumn("values", F.split(F.trim(col), delimiter).cast("array<double>"))


def parse_labelled(lines: DataFrame, col: str) -> DataFrame:
    """Adds ``label``, the first token, and ``values``, the others."""
    tokens = F.split(F.trim(col), r"\s+").cast("array<double>")
    return lines.withColumn("_t", tokens).select(*lines.columns, F.col("_t")[0].cast("int").alias("label"), F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))).alias("values"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled(spark.read.text(path), "value").drop("value")
