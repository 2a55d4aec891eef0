"""Importance resampling towards a target text collection.

Documents are scored by hashed n-gram features: a feature's gain is the log ratio of its
bucket's share in the target and in the documents, a document's weight the sum of its
gains. Gumbel noise from a hash of the id turns the weights into a draw without
replacement: the k highest scores are drawn.

The k-th score is found by radix selection: histograms of one digit of the composite key
(score downwards, doc_id upwards) at a time, each a small aggregation. Only the drawn
rows are sorted, by ranges, and numbered by the row counts of the ranges before them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, release, small_batches, stage, table, text_parts
from .decontam import words_in

BUCKETS = 10_000
#: Longest run of words that is a feature.
WORDS = 3
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bits of a digit of the selection key: a histogram has at most 2 to this power rows.
DIGIT = 14
#: Drawn rows of a range that is sorted in one task, about.
RANGE_ROWS = 1_000_000


def _shift(length: int) -> np.ndarray:
    """4 x 256 table of what ``length`` more bytes do to a crc32, by the bytes of the crc; the map is linear over bits."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            moved = zlib.crc32(zeros, 1 << (8 * byte + bit)) ^ base
            step = 1 << bit
            out[byte, step : 2 * step] = out[byte, :step] ^ np.uint32(moved)
    return out


_short_shift = lru_cache(maxsize=512)(_shift)


class Features:
    """Buckets of the n-grams of a batch of texts.

    ``buckets[n]`` has the buckets of all runs of n + 1 words, ``owner[n]`` the texts' numbers, ``words`` the word count of each text.
    """

    def __init__(self, texts: pa.Array, longest: int = WORDS, buckets: int = BUCKETS):
        at, known, parent = words_in(texts)
        self.words = np.bincount(parent, minlength=len(texts)).astype(np.int64)
        alone = np.array([zlib.crc32(w) for w in known], dtype=np.uint32)[at] if known else np.zeros(0, dtype=np.uint32)
        joined = np.array([zlib.crc32(b" " + w) for w in known], dtype=np.uint32)[at] if known else alone
        lengths, which = np.unique(np.array([len(w) + 1 for w in known], dtype=np.int64), return_inverse=True)
        shifts = np.stack([_short_shift(int(n)) if n <= 256 else _shift(int(n)) for n in lengths]).reshape(-1) if known else np.zeros(0, dtype=np.uint32)
        place = which[at] * 1024 if known else at
        self.buckets, self.owner = [], []
        crc, first = alone, parent
        for n in range(longest):
            if n:
                crc, row = crc[:-1], place[n:]
                moved = shifts[row + (crc & 255)]
                for byte in (1, 2, 3):
                    moved ^= shifts[row + (256 * byte) + ((crc >> np.uint32(8 * byte)) & np.uint32(255))]
                crc, first = moved ^ joined[n:], first[:-1]
            inside = first == parent[n:]
            self.buckets.append((crc[inside] % np.uint32(buckets)).astype(np.int32))
            self.owner.append(first[inside])

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for b in self.buckets)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, summed gains) of each text."""
        n = len(self.words)
        total = sum(np.bincount(o, minlength=n) for o in self.owner)
        weight = sum(np.bincount(o, weights=gains[b], minlength=n) for o, b in zip(self.owner, self.buckets, strict=True))
        return total.astype(np.int64), np.asarray(weight).astype(np.int64)


def _text(df: DataFrame) -> Column:
    return F.col("text").cast("string").alias("text") if "text" in df.columns else F.lit(None).cast("string").alias("text")


def bucket_counts(texts: DataFrame, longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Tasks sum their own rows first; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_parts(batch, "text"):
                held += Features(part.column("text"), longest, buckets).counts(buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["bucket", "n"])
        release()

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(_text(texts)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths: the same on every run. An id of null counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score(docs: DataFrame, gain: np.ndarray, *, longest: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                found = Features(part.column("text"), longest, len(held.value))
                total, weight = found.sums(held.value)
                drawn = np.array([noise(i, seed) for i in part.column("doc_id").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in (found.words, total, weight, weight + drawn))], ["doc_id", "n_words", "n_features", "weight", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs)).mapInArrow(run, _SCORED)


def _digits(low: int, high: int, up: bool, name: str) -> list[Column]:
    """The digits, highest first, of a column whose values lie from low to high.

    With ``up`` small values come first, else large ones. Differences are taken as
    decimals, which hold all 64 bits, and cut into two longs.
    """
    span, out = high - low, []
    places = max(1, -(-span.bit_length() // DIGIT))
    value = (F.col(name).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) if up else (F.lit(high).cast("decimal(20,0)") - F.col(name).cast("decimal(20,0)"))
    # at most 2^64 - 1, as two longs
    half = F.lit(1 << 32).cast("decimal(20,0)")
    top, rest = F.floor(value / half).cast("long"), (value % half).cast("long")
    for p in reversed(range(places)):
        shift = p * DIGIT
        if shift >= 32:
            digit = F.shiftright(top, shift - 32)
        else:
            digit = F.shiftright(rest, shift).bitwiseOR(F.shiftleft(top, 32 - shift))
        out.append(digit.bitwiseAND((1 << DIGIT) - 1))
    return out


def kth_key(rows: DataFrame, k: int) -> tuple[Column, Column, int, int]:
    """(is before the k-th key, has that key, rows with that key among the first k, rows with that key).

    The key is the score downwards, then doc_id upwards, null last, then n_features
    downwards. Each step takes one digit of it: the rows that share all digits so far are counted
    by the next one, and the digit in which the k-th row lies is fixed. 0 < k <= rows.
    """
    low, high, least, most, few, many = rows.agg(F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id"), F.min("n_features"), F.max("n_features")).first()
    steps = _digits(low, high, False, "score") + [F.col("doc_id").isNull().cast("long")]
    if least is not None:
        steps += [F.coalesce(d, F.lit(0)) for d in _digits(least, most, True, "doc_id")]
    steps += _digits(few, many, False, "n_features")
    before, same, left, equal = F.lit(False), F.lit(True), k, 0
    for digit in steps:
        counts = sorted(tuple(r) for r in rows.where(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
        for value, equal in counts:
            if left <= equal:
                break
            left -= equal
        before, same = before | (same & (digit < value)), same & (digit == value)
    return before, same, left, equal


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` sorted by ranges of the key and staged, with place: the range in its high bits, the number inside it in the low 33."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    ranges = rows.repartitionByRange(max(1, math.ceil(count / RANGE_ROWS)), *order).sortWithinPartitions(*order)
    return stage(ranges.withColumn("place", F.monotonically_increasing_id()), "drawn")


def numbered(placed: DataFrame) -> DataFrame:
    """The rows of ``ranked`` with rank 1, 2, 3 ...: a row's number inside its range after the rows of the ranges before it."""
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, total))
        total += n
    known = placed.sparkSession.createDataFrame(offsets, "part long, offset long")
    return placed.withColumn("part", part).join(F.broadcast(known), "part").withColumn("rank", F.col("offset") + nth + 1).drop("part", "offset", "place")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank numbers the drawn ones, null for all others.

    Of the documents with at least ``least_words`` words, floor(percent * N / 100) are
    drawn: the highest scores, ties to the smaller doc_id, a null id last. Rows that repeat a
    doc_id are documents of their own; of those with equal scores the one with more features
    goes first, and equal rows are told apart only by their ranks. Null and empty texts have no features
    and weight 0. Only ``doc_id`` and ``text`` are read, of the target only ``text``; other columns may have
    any names. With an empty target a frequent feature loses and a rare one gains; empty documents give no rows.

    The driver holds one number a bucket and one histogram of 2^14 rows at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = ["doc_id", "n_features", "weight", "score"]
    with passing(spark) as keep:
        gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
        scored = keep(stage(score(docs, gain, longest=longest, seed=seed), "scored"))
        long_ = F.col("n_words") >= least_words
        k = scored.where(long_).count() * percent // 100
        if not k:
            return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
        before, same, left, equal = kth_key(scored.where(long_), k)
        border = scored.where(long_ & same).select(columns).first()
        repeat = lambda n: spark.range(n).select(*[F.lit(border[c]).cast("long").alias(c) for c in columns])
        drawn = keep(ranked(scored.where(long_ & before).select(columns).unionByName(repeat(left)), k))
        undrawn = scored.where(~(long_ & (before | same))).select(columns).unionByName(repeat(equal - left))
    return numbered(drawn).unionByName(undrawn.withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
