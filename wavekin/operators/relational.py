"""Evaluation operators on tables of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .learning import percentiles

#: Groups whose one value is broadcast, at most.
BROADCAST_ROWS = 500_000


def read_logs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with headers below a folder, with the columns dataset, configuration and variant from their paths .../dataset/configuration/variant.csv."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = lambda i: F.url_decode(F.element_at(parts, -i))
    return rows.select("*", name(3).alias("dataset"), name(2).alias("configuration"), F.regexp_replace(name(1), r"\.csv$", "").alias("variant"))


def drop_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Without the last row of each group, a trailer. Rows that share the last place all go."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    return df.join(last, keys).where(F.col(order) < F.col("_last")).select(df.columns)


def relative_to_first(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ratio (value / first) and speedup (first / value) within each group."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("ratio", F.col(value) / first).withColumn("speedup", first / F.col(value))


def pivot(df: DataFrame, index: list[str], columns: str, values: list, agg: Column) -> DataFrame:
    """One column for each of the named values."""
    return df.groupBy(*index).pivot(columns, values).agg(agg)


def average_rank(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(method, avg_rank): mean over blocks of the methods' ranks, ties sharing the mean of theirs."""
    w = Window.partitionBy(block)
    ties = F.count("*").over(Window.partitionBy(block, value))
    ranked = df.withColumn("_r", F.rank().over(w.orderBy(value)) + (ties - 1) / 2)
    return ranked.groupBy(method).agg(F.avg("_r").alias("avg_rank"))


def box(df: DataFrame, keys: list[str], value: str, z: float = 1.96) -> DataFrame:
    """Quartiles, and the mean with its normal interval."""
    half = z * F.stddev(value) / F.sqrt(F.count(value))
    means = df.groupBy(F.struct(*keys).alias("seg")).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))
    quartiles = percentiles(df.select(F.struct(*keys).alias("seg"), F.col(value).alias("x")), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return means.join(quartiles, "seg", "left").select(*[F.col(f"seg.{k}").alias(k) for k in keys], "q1", "q2", "q3", "mean", "low", "high")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density): bins 1 .. bins, 0 below and bins + 1 from ``high`` on; density in units of the value."""
    counted = df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total") * bins / (high - low)).alias("density"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right, difference) of two logs side by side; rows of one only have nulls."""
    left, right = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    return left.join(right, key, "full").withColumn("difference", F.col("left") - F.col("right"))


def approximation(exact: Column, approximate: Column) -> Column:
    """exact / approximate distance, guarded against zeros."""
    return (exact + 1e-8) / (approximate + 1e-8)
