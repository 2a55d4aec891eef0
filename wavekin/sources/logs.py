"""Statistics of an index and of its queries as CSV files, in the folders that ``relational.read_logs`` reads."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str) -> None:
    # one row, or one for each query of a stated set
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index_logs(index, folder: str) -> None:
    """settings (key, value), tree (subtrees, avg_depth, avg_leaf_size) and index (records, leaves, ...) below ``folder``."""
    spark = index.rows.sparkSession
    settings = [(k, str(v)) for k, v in asdict(index.config).items()]
    _write(spark.createDataFrame(settings, "key string, value string"), f"{folder}/settings")
    _write(index.tree_stats(), f"{folder}/tree")
    _write(index.info(), f"{folder}/index")


def write_query_log(answers: DataFrame, pruned: DataFrame, folder: str) -> None:
    """One line a query (q_id, distance, rows, pruned, needed), and behind them the averages with an empty q_id."""
    lines = pruned.join(answers.groupBy("q_id").agg(F.min("dist").alias("distance")), "q_id", "left")
    names = ["distance", "rows", "pruned", "needed"]
    lines = lines.select("q_id", *[F.col(c).cast("double").alias(c) for c in names])
    mean = lines.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit(None).cast("long").alias("q_id"), *names)
    _write(lines.unionByName(mean).orderBy(F.asc_nulls_last("q_id")), f"{folder}/query")
