"""Continuous queries: a stream of queries against static series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import approximate, brute_force, knn


def answer_stream(queries: DataFrame, answer, out: str, checkpoint: str, **trigger):
    """Start a streaming query: each micro-batch of (q_id, values) is answered by ``answer(batch)`` and added to the table ``out``.

    A batch that is run again after a failure replaces its own part of the table.
    """

    def each(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def searcher(series: DataFrame | None = None, index=None, k: int = 1, approximately: bool = False):
    """The function that answers a batch: brute force over series, or by an index, exactly or approximately."""
    if index is None:
        return lambda batch: brute_force(series, batch, k)
    return (lambda batch: approximate(index, batch, k)) if approximately else (lambda batch: knn(index, batch, k))


def run_available(spark: SparkSession, source: str, folder: str, series: DataFrame, k: int) -> DataFrame:
    """Answer all queries there are in the folder ``source`` and stop; the answers."""
    stream = spark.readStream.schema("q_id long, values array<double>").option("maxFilesPerTrigger", 2).parquet(source)
    answer_stream(stream, searcher(series, k=k), f"{folder}/answers", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/answers").select("q_id", "rank", "series_id", "dist")


def running_history(answers: DataFrame, out: str, checkpoint: str, **trigger):
    """Start a streaming query over a stream of answers (q_id, latency, step): after each batch one row (batch, step, queries, answers, avg_latency) of all that came so far is added to the table ``out``.

    The state has one row for each different query, spread by q_id, so the number of queries is
    exact and no task holds them all; a batch that is run again replaces its own row. ``step`` is the largest one seen.
    """
    per_query = answers.groupBy("q_id").agg(F.count("*").alias("n"), F.count("latency").alias("timed"), F.sum("latency").alias("latency"), F.max("step").alias("step"))

    def each(state: DataFrame, number: int) -> None:
        totals = state.agg(F.max("step").alias("step"), F.count("*").alias("queries"), F.sum("n").alias("answers"), (F.sum("latency") / F.sum("timed")).alias("avg_latency"))
        totals.select(F.lit(number).cast("long").alias("number"), "*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return per_query.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def history(answers: DataFrame) -> DataFrame:
    """(queries, answers, avg_dist): totals of a table of answers; of a stream, for the complete output mode, with an approximate number of queries (``running_history`` has the exact one)."""
    queries = F.approx_count_distinct("q_id") if answers.isStreaming else F.count_distinct("q_id")
    return answers.agg(queries.alias("queries"), F.count("*").alias("answers"), F.avg("dist").alias("avg_dist"))


def register_views(spark: SparkSession, answers: str, index=None) -> None:
    """Temporary views over the table of answers, new at every query: ``history``, one row a batch, and ``stats``, the totals, with those of the index if there is one."""
    rows = spark.read.schema("q_id long, rank int, series_id long, dist double, batch long").parquet(answers)
    rows.groupBy("batch").agg(F.count_distinct("q_id").alias("queries"), F.count("*").alias("answers"), F.avg("dist").alias("avg_dist")).createOrReplaceTempView("history")
    totals = rows.agg(F.count_distinct("q_id").alias("queries"), F.count("*").alias("answers"), F.avg("dist").alias("avg_dist"))
    (totals if index is None else totals.join(index.info(), how="cross")).createOrReplaceTempView("stats")


def generated_queries(spark: SparkSession, n: int, per_second: int = 1, seed: int = 1) -> DataFrame:
    """An endless stream of random-walk queries."""
    from ..functions.arrays import random_walk

    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.col("value").alias("q_id"), random_walk(F.col("value"), n, seed).alias("values"))
