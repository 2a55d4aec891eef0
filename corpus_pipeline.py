"""A corpus pipeline: language, near-duplicates, benchmark leaks, source weights, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept.
All but the last return the columns of ``docs``. Stages name documents by doc_id: rows that
share one stay, go or are copied together, and rows without one stay, once, unless
language ID rejects them. Null, empty and very long texts are treated as the operators
say; language ID drops texts without a letter, so later stages see none. Empty documents
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekin.llm import decontam, langid, mixing, near_dedup, token_store
from wavekin.llm.common import passing, remove, stage, table, tidy

#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Jaccard similarity in percent from which the near-dedup stage links documents.
NEAR_PERCENT = 80

#: No single SQL statement trains a classifier or runs a tokenizer, so run() has no oracle;
#: tests check each stage against brute force.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the documents named in the staged ``ids`` (doc_id)."""
    return docs.join(_small(ids), "doc_id", "left_anti").select(docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the calibrated model rejects go."""
    tidy(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    to = _fresh(docs, "_language")
    return langid.predict(docs, model, F.col("text"), to=to).where(F.col(to)["accepted"]).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component the document of smallest id stays."""
    tidy(spark)
    judged = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT)
    return _without(docs, stage(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark passage go."""
    tidy(spark)
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stage(judged.where("contaminated and doc_id is not null").select("doc_id").distinct(), "leaks"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document stands in the result as often as it is to be copied."""
    tidy(spark)
    to = _fresh(docs, "_copies")
    copies = stage(mixing.mix_sources(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(to)), "copies")
    repeated = docs.join(_small(copies), "doc_id", "left").withColumn(to, F.coalesce(to, F.lit(1)).cast("long")).where(F.col(to) > 0)
    return repeated.withColumn(to, F.explode(F.sequence(F.lit(1).cast("long"), F.col(to)))).select(docs.columns)


def store_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output: the store's documents, read back from its files."""
    tidy(spark)
    return token_store.store_and_read(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("token_store", store_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and then what led to it is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(stage(apply(spark, docs, sf_dir), name))
        if before is not None:
            remove(spark, before)
        before = docs.staged_path
    return STAGES[-1][1](spark, docs, sf_dir)
