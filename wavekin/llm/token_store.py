"""Token ids in a content-addressed store.

A store is a folder of four Parquet tables:

* ``chunks``: (digest, n, payload). A rolling hash over the last ``ROLL`` ids cuts every
  document's id stream into chunks, so an insertion moves only the cuts near it. Each
  distinct chunk is stored once under the digest of its little-endian ids.
* ``recipes``: (part, doc_id, n_tokens, digests) in ascending doc_id order: part p's ids are not above part
  p + 1's, and rows are sorted within a part. Null ids come first.
* ``parts``: (part, docs, tokens, first_doc, first_token), where each part of the recipes starts.
* ``manifest``: (level, node, hash), a Merkle tree over the recipes in order, a folder for each level. Level 0 has
  a leaf for each document, a node hashes up to ``FAN`` nodes below, the last level is the root.

Ids are unsigned 16-bit where the vocabulary allows, else unsigned 32-bit.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, remove, scratch, small_batches, table, text_parts
from .word_encoder import WordEncoder, encoder_of  # noqa: F401  the encoder is part of this module's interface

ROLL, LEAST, MOST, MASK = 16, 128, 2048, (1 << 9) - 1
FAN = 1024
#: Ids hashed at a time.
BLOCK = 1 << 18

_U = np.uint64


def _salts(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


_SALT = _salts(1 << 16)


def _marks(ids: np.ndarray) -> list[int]:
    """Positions after which the rolling hash is 0 under MASK."""
    out = []
    for lo in range(0, len(ids), BLOCK):
        base = max(0, lo - ROLL + 1)
        value = _SALT[ids[base : lo + BLOCK] & 0xFFFF]
        rolled = value.copy()
        for j in range(1, ROLL):
            rolled[j:] += value[:-j] << _U(j * 3)
        hits = np.flatnonzero(((rolled[lo - base :] >> _U(40)) & _U(MASK)) == 0)
        out += (hits + lo + 1).tolist()
    return out


def cuts(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """For each of several id streams laid end to end: the end positions of its chunks.

    A chunk ends where the rolling hash says so, LEAST to MOST ids apart. The hash looks
    back fewer ids than LEAST, so no stream's cuts depend on the one before.
    """
    marks = _marks(ids)
    out, at = [], 0
    for count in counts.tolist():
        n, ends = at + count, []
        while n - at > LEAST:
            i = bisect_left(marks, at + LEAST)
            at = min(marks[i] if i < len(marks) else n, at + MOST, n)
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
        at = n
    return out


def cut(ids: np.ndarray) -> list[int]:
    """End positions of the chunks of one id stream."""
    return cuts(ids, np.array([len(ids)]))[0]


_CHUNK = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("fresh", pa.list_(_CHUNK))])


def _encode(batches: Iterator[pa.RecordBatch], encoder: WordEncoder, end_id: int | None, width: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``_encoded``, about PART_BYTES of text at a time: rows may be long, so a batch of them has no bounded size."""
    size = np.dtype(width).itemsize
    seen: set[bytes] = set()
    for batch in (part for whole in batches for part in text_parts(whole, "text")):
        ids, counts = encoder.encode_batch(batch.column("text").to_pylist(), end_id)
        data = memoryview(ids.astype(width).tobytes())
        recipes, digests, at = [0], [], 0
        fresh, new, sizes, payloads = [0], [], [], []
        for ends in cuts(ids, counts):
            for end in ends:
                payload = data[at * size : end * size]
                digest = hashlib.blake2b(payload, digest_size=16).digest()
                digests.append(digest)
                if digest not in seen:
                    seen.add(digest)
                    new.append(digest)
                    sizes.append(end - at)
                    payloads.append(bytes(payload))
                at = end
            recipes.append(len(digests))
            fresh.append(len(new))
        chunks = pa.StructArray.from_arrays([pa.array(new, pa.binary()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())], fields=list(_CHUNK))
        columns = [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(recipes, pa.int32()), pa.array(digests, pa.binary())), pa.ListArray.from_arrays(pa.array(fresh, pa.int32()), chunks)]
        yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)


def _encoded(docs: DataFrame, tokenizer_path: str, end_id: int | None, width: str) -> DataFrame:
    """(doc_id, n_tokens, digests, fresh): fresh has the chunks not seen before by the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode(batches, encoder_of(tokenizer_path), end_id, width)
        release()

    return docs.mapInArrow(run, "doc_id long, n_tokens long, digests array<binary>, fresh array<struct<digest:binary,n:int,payload:binary>>")


def _leaves(recipes: DataFrame) -> DataFrame:
    """(node, hash) of level 0."""
    shown = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens"), F.array_join(F.transform("digests", F.hex), ":"))
    return recipes.select(F.col("nth").alias("node"), F.sha2(shown, 256).alias("hash"))


def merkle(leaves: DataFrame, folder: str) -> None:
    """Write all levels of the tree to ``folder``, from the leaves up to the root. No leaves, no levels."""
    spark = leaves.sparkSession
    now, level = leaves, 0
    while True:
        here = f"{folder}/level={level}"
        now.write.option("compression", "zstd").parquet(here)
        now = spark.read.schema("node long, hash string").parquet(here)
        if now.count() <= 1:
            return
        level += 1
        up = now.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below"))
        now = up.select("node", F.sha2(F.array_join("below.hash", ","), 256).alias("hash"))


def root_of(spark: SparkSession, folder: str) -> list[str]:
    """The root's hash, the one row of the last level; none for an empty store."""
    held = spark.read.schema("node long, hash string, level int").parquet(folder)
    top = held.agg(F.max("level")).first()[0]
    return [] if top is None else [r["hash"] for r in held.where(F.col("level") == top).take(2)]


def ordered(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with nth (place in the order, from 0) and start (ids of all documents before)."""
    parts = spark.read.parquet(f"{path}/parts")
    before = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "digests").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.parquet(f"{path}/recipes").withColumns({"in_part": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "row": F.count(F.lit(1)).over(before)})
    # as many rows as the recipes have files
    return rows.join(F.broadcast(parts.select("part", "first_doc", "first_token")), "part").select("part", "doc_id", "n_tokens", "digests", (F.col("first_doc") + F.col("row")).alias("nth"), (F.col("first_token") + F.col("in_part")).alias("start"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the store to the folder ``path``.

    A null text counts as empty. Rows that repeat a doc_id are stored each, next to each
    other; null ids come first. Other columns are ignored. Empty documents leave a store
    without chunks and recipes.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = scratch(spark, "encoded")
    plan = _encoded(rows, tokenizer_path, end_id, width)
    plan.write.option("compression", "zstd").parquet(held)
    encoded = spark.read.schema(plan.schema).parquet(held)

    first = F.row_number().over(Window.partitionBy("digest").orderBy("digest"))
    chunks = encoded.select(F.explode("fresh").alias("c")).select("c.*")
    chunks.withColumn("nth", first).where("nth = 1").drop("nth").write.option("compression", "zstd").parquet(f"{path}/chunks")

    order = [F.asc_nulls_first("doc_id"), "n_tokens", "digests"]
    recipes = encoded.select("doc_id", "n_tokens", "digests").repartitionByRange(*order).sortWithinPartitions(*order)
    recipes.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove(spark, held)

    per_part = spark.read.schema("part int, doc_id long, n_tokens long, digests array<binary>").parquet(f"{path}/recipes").groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    # one row for each recipe file, not for documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part.select("*", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token")).write.parquet(f"{path}/parts")
    spark.range(1).select(F.lit(width).alias("ids")).coalesce(1).write.parquet(f"{path}/format")
    merkle(_leaves(ordered(spark, path)), f"{path}/manifest")


def _operators() -> np.ndarray:
    """For n = 0..MOST ids of 4 bytes: what appending them does to each bit of a CRC-32."""
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, (table_ >> 1) ^ np.uint32(0xEDB88320), table_ >> 1).astype(np.uint32)
    now = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = np.empty((MOST + 1, 32), dtype=np.uint32)
    for n in range(MOST + 1):
        out[n] = now
        for _ in range(4):
            now = (now >> np.uint32(8)) ^ table_[now & np.uint32(0xFF)]
    return out


def _append_crc(operators: np.ndarray, crc: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """CRC of A + B from those of A and B and B's length in ids."""
    matrix, out = operators[n], more.copy()
    for bit in range(32):
        out ^= np.where((crc >> np.uint32(bit)) & np.uint32(1), matrix[:, bit], np.uint32(0))
    return out


def _checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc) of every chunk as its payload says."""
    width = spark.read.parquet(f"{path}/format").first()["ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.frombuffer(p, width) for p in pdf["payload"]]
            yield pd.DataFrame({"digest": [hashlib.blake2b(p, digest_size=16).digest() for p in pdf["payload"]], "n": [len(i) for i in ids], "crc": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]})

    return spark.read.parquet(f"{path}/chunks").select("payload").mapInPandas(run, "digest binary, n long, crc long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files.

    Each chunk's digest, length and CRC are computed anew from its payload; a recipe
    whose chunks are missing, changed or of another total length fails the query. Recipes
    that no longer have the manifest's root fail this call. The
    document's CRC is put together from its chunks', so no payload is shuffled.
    """
    if not verify(spark, path):
        raise ValueError("the store's recipes do not have the manifest's root")
    pieces = ordered(spark, path).select("nth", F.posexplode("digests").alias("seq", "digest"))
    found = pieces.join(_checked_chunks(spark, path), "digest", "left")
    lost = F.when(F.col("crc").isNull(), F.raise_error(F.lit("the store misses a chunk or holds a changed one"))).otherwise(F.col("crc"))
    per_doc = found.select("nth", F.struct("seq", "n", lost.alias("crc")).alias("c")).groupBy("nth").agg(F.array_sort(F.collect_list("c")).alias("cs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        operators = _operators()
        for pdf in batches:
            counts = np.array([len(c) for c in pdf["n"]], dtype=np.int64)
            n, crc = (np.concatenate(pdf[c].tolist()).astype(np.int64) if len(pdf) else np.zeros(0, np.int64) for c in ("n", "crc"))
            first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
            out = np.zeros(len(pdf), dtype=np.uint32)
            for k in range(int(counts.max(initial=0))):
                live = np.flatnonzero(counts > k)
                at = first[live] + k
                out[live] = _append_crc(operators, out[live], n[at], crc[at].astype(np.uint32))
            yield pd.DataFrame({"nth": pdf["nth"], "ids": [int(v) for v in np.add.reduceat(n, first)] if len(pdf) else [], "ids_crc32": out.astype(np.int64)})

    crcs = per_doc.select("nth", F.col("cs.n").alias("n"), F.col("cs.crc").alias("crc")).mapInPandas(run, "nth long, ids long, ids_crc32 long")
    whole = ordered(spark, path).select("nth", "doc_id", "start", "n_tokens").join(crcs, "nth", "left")
    short = F.when(F.coalesce("ids", F.lit(0)) != F.col("n_tokens"), F.raise_error(F.lit("a recipe's chunks have another length"))).otherwise(F.col("n_tokens"))
    return whole.select("doc_id", "start", short.alias("n_tokens"), F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"))


def reconstruct(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(nth, doc_id, ids): the id streams themselves, of all documents or of the doc_ids in ``only``."""
    width = spark.read.parquet(f"{path}/format").first()["ids"]
    rows = ordered(spark, path)
    rows = rows if only is None else rows.join(only.select("doc_id"), "doc_id", "left_semi")
    pieces = rows.select("nth", "doc_id", F.posexplode("digests").alias("seq", "digest")).join(spark.read.parquet(f"{path}/chunks"), "digest")
    per_doc = pieces.groupBy("nth", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("c")).select("nth", "doc_id", F.col("c.payload").alias("payloads"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"nth": pdf["nth"], "doc_id": pdf["doc_id"].astype("Int64"), "ids": [np.frombuffer(b"".join(p), width).astype(np.int32) for p in pdf["payloads"]]})

    return per_doc.mapInPandas(run, "nth long, doc_id long, ids array<int>")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes still have the manifest's root."""
    again = scratch(spark, "merkle")
    merkle(_leaves(ordered(spark, path)), again)
    same = root_of(spark, f"{path}/manifest") == root_of(spark, again)
    remove(spark, again)
    return same


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def store_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "token-store")
    write_store(docs, path, tokenizer_path or tokenizer_file())
    return read_store(spark, path)


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))
