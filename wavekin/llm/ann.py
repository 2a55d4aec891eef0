"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector gets a long hash string per tree, the signs of its products with random
directions. A tree is the sorted array of these strings: a query finds its longest
matching prefix by bisection, and the entries that share a shorter prefix are a wider
range around that place. A search descends in all trees, then ascends in all of them at
once, one prefix length at a time, until the ranges hold enough entries. Their vectors
are compared exactly.

Largest inner product is turned into nearest direction by one more coordinate, which
brings every stored vector to the largest norm; queries have 0 there.

The rows are spread over segments by a hash of their id; each segment is indexed by a
forest of its own, whose sorted arrays are written to the shared folder. The queries are a stated set. They
are broadcast in blocks of bounded size, so a task holds one segment and one block, and only
each segment's best come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, stage, table

TREES, BITS = 32, 24
#: Rows of a segment, about, and queries that a task looks up at a time.
SEGMENT, BLOCK = 8192, 512
#: Bytes of queries that are broadcast at a time; the index is read once for each block of them.
QUERY_BYTES = 64 << 20
#: Entries of the ranges of all trees, as a share of the segment's rows, that end the ascent.
#: The test embeddings have no clusters (20th neighbours at 68 degrees, all others at 90), so wide ranges are needed.
BUDGET = 0.9
LEAST = 1600


def directions(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits)).astype(np.float32)


def hash_strings(vectors: np.ndarray, planes: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows, trees) uint32: strings of ``bits`` bits, first bit most significant."""
    signs = (vectors.astype(np.float32) @ planes > 0).reshape(len(vectors), trees, bits)
    return (signs * (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)


class Forest:
    """Sorted hash strings of one segment's vectors."""

    def __init__(self, order: np.ndarray, ordered: np.ndarray, bits: int = BITS):
        self.order, self.sorted, self.bits = order, ordered, bits

    @staticmethod
    def plant(strings: np.ndarray, bits: int = BITS) -> Forest:
        order = np.argsort(strings, axis=0, kind="stable").astype(np.int32)
        return Forest(order, np.take_along_axis(strings, order, axis=0), bits)

    def ranges(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the entries that share the queries' first ``length`` bits, each (queries, trees)."""
        shift = np.uint64(self.bits - length)
        first = (strings.astype(np.uint64) >> shift) << shift
        last = first + (np.uint64(1) << shift)
        low, high = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t in range(strings.shape[1]):
            row = self.sorted[:, t].astype(np.uint64)
            low[:, t] = np.searchsorted(row, first[:, t], side="left")
            high[:, t] = np.searchsorted(row, last[:, t], side="left")
        return low, high

    def candidates(self, strings: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Row numbers for each query: all entries at the longest common prefix length at which the trees hold ``enough``."""
        low, high = self.ranges(strings, self.bits)
        open_ = np.flatnonzero((high - low).sum(axis=1) < enough)
        for length in range(self.bits - 1, -1, -1):
            if not len(open_):
                break
            low[open_], high[open_] = self.ranges(strings[open_], length)
            open_ = open_[(high[open_] - low[open_]).sum(axis=1) < enough]
        hit = np.zeros(len(self.order), dtype=bool)
        for q in range(len(strings)):
            hit[:] = False
            for t in range(strings.shape[1]):
                hit[self.order[low[q, t] : high[q, t], t]] = True
            yield np.flatnonzero(hit)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) with a non-zero vector of finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, dim: int, largest: float, segments: int) -> DataFrame:
    """One row for each segment: (segment, n, ids, vectors, places, sorted), packed arrays, staged. ``rows`` are (vec_id, v)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.array(pdf["v"].tolist(), dtype=np.float64)
        rest = np.sqrt(np.maximum(0, largest**2 - (x**2).sum(axis=1)))[:, None]
        forest = Forest.plant(hash_strings(np.hstack([x, rest]), directions(dim + 1)))
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "n": [len(pdf)], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "places": [forest.order.tobytes()], "sorted": [forest.sorted.tobytes()]})

    keyed = rows.select(F.pmod(F.xxhash64("vec_id", F.lit("segment")), F.lit(segments)).cast("int").alias("segment"), "vec_id", "v")
    return stage(keyed.repartition(segments, "segment").groupBy("segment").applyInPandas(pack, "segment int, n int, ids binary, vectors binary, places binary, sorted binary"), "forest")


def _asked(queries: DataFrame, dim: int) -> DataFrame:
    """(query_id, v, strings), staged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = directions(dim + 1)
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=np.float64)
                yield pdf.assign(strings=[s.tobytes() for s in hash_strings(np.hstack([x, np.zeros((len(x), 1))]), planes)])

    return stage(queries.select("query_id", "v").mapInPandas(run, "query_id long, v array<double>, strings binary"), "queries")


def search(index: DataFrame, queries: DataFrame, dim: int, k: int, *, budget: float = BUDGET, least: int = LEAST, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best found for each query (query_id, v), not itself."""
    asked = _asked(queries, dim)
    context = asked.sparkSession.sparkContext
    blocks = max(1, -(-asked.count() * (dim * 8 + TREES * 4) // query_bytes))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)) == b).toPandas().sort_values("query_id")
        held = context.broadcast((part["query_id"].to_numpy(np.int64), np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), dim), np.frombuffer(b"".join(part["strings"]), np.uint32).reshape(len(part), TREES)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            q_ids, q, strings = held.value
            for pdf in batches:
                for r in pdf.itertuples():
                    ids = np.frombuffer(r.ids, np.int64)
                    x = np.frombuffer(r.vectors).reshape(len(ids), dim)
                    forest = Forest(np.frombuffer(r.places, np.int32).reshape(len(ids), TREES), np.frombuffer(r.sorted, np.uint32).reshape(len(ids), TREES))
                    for lo in range(0, len(q_ids), BLOCK):
                        out = []
                        for i, rows in enumerate(forest.candidates(strings[lo : lo + BLOCK], max(least, int(budget * len(ids)))), lo):
                            rows = rows[ids[rows] != q_ids[i]]
                            score = np.einsum("ij,j->i", x[rows], q[i])
                            # ids ascend within a segment, so a stable order settles ties by the smaller id
                            best = np.argsort(-score, kind="stable")[:k]
                            out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[rows[best]], "score": score[best]}))
                        if out:
                            yield pd.concat(out, ignore_index=True)

        # written, so that the driver holds one block of queries at a time
        one = stage(index.select("ids", "vectors", "places", "sorted").mapInPandas(run, "query_id long, vec_id long, score double"), "found")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", budget: float = BUDGET, least: int = LEAST) -> DataFrame:
    """The ``k`` candidates of largest inner product found for each query, nearest first, ties to the smaller id.

    Returns (query_id, rank, vec_id, score), score in double precision on the vectors as given. Rows whose vector
    is null, empty, zero, or holds a null or non-finite component take no part, nor do
    rows without an id or, as candidates, rows of another length than the commonest. A
    row that repeats id and vector counts once. With fewer candidates than ``k`` all found are returned. Ids are
    taken as unique; of rows that share one, each is a candidate of its own. Other columns of
    the inputs are ignored. An empty table gives no rows.
    """
    with passing(corpus.sparkSession) as keep:
        rows = stage(_usable(corpus, id_col, vector_col).distinct(), "vectors")
        sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if sizes is None:
            return corpus.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dim, n = sizes
        rows = rows.where(F.size("v") == dim)
        asked = _usable(queries, id_col, vector_col).where(F.size("v") == dim).select(F.col("vec_id").alias("query_id"), "v").distinct()
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        largest = rows.agg(F.max(norm)).first()[0]
        index = build_index(rows, dim, largest, -(-n // SEGMENT))
        return keep(stage(search(index, asked, dim, k, budget=budget, least=least), "nearest"))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
