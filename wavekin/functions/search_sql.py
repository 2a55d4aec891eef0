"""Exact k-NN over a stored index as a table function of SQL.

``register_knn`` makes ``knn(query, k)`` known to a session:

    SELECT q.id, n.* FROM queries q, LATERAL knn(q.values, 5) n

Each row's query is answered where the row lies, from the index's files: the leaves in the order of their
bounds, and of those only the ones that the k-th best distance leaves open. For few
queries beside other SQL; sets of queries go through ``operators.search``, which shares what it reads.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.index import SeriesIndex, leaves_folder
from ..sources.matrix import _file_system
from .kernels import WordBounds, coefficients_of, matrix_of

#: Rows of leaves that a task keeps between queries, at most.
KEPT_ROWS = 200_000
#: Leaves that a query opens first, each time twice as many, and rows that it opens at a time beyond one leaf, at most.
FIRST_LEAVES, OPEN_ROWS = 8, 50_000


def summary_of(x: np.ndarray, config, model) -> np.ndarray:
    """The vector that the index's words are made from, of one prepared series."""
    if config.summarization == "sfa":
        return coefficients_of(x[None, :], list(model.coefficients))[0]
    return x[: config.w * config.segment].reshape(config.w, -1).mean(axis=1)


def register_knn(spark: SparkSession, path: str, name: str = "knn") -> None:
    """Make ``name``(query ARRAY<DOUBLE>, k INT) -> (rank, series_id, dist) of the index stored at ``path``, as it is now.

    ``pyarrow`` must reach the path. A query that is null, of another length or has nulls or NaN has no answers.
    """
    index = SeriesIndex.load(spark, path)
    config, model, folder = index.config, index.model, leaves_folder(spark, path)

    class Knn:
        def __init__(self):
            self.store, self.place = _file_system(path)
            leaves = ds.dataset(f"{_file_system(folder)[1]}", filesystem=self.store, format="parquet").to_table(columns=["leaf_id", "lo", "hi", "parts", "n_rows"]).combine_chunks()
            self.names, self.parts = leaves["leaf_id"].to_pylist(), leaves["parts"].to_pylist()
            self.sizes = leaves["n_rows"].to_numpy()
            self.bounds = WordBounds(config, model)
            ends = [matrix_of(leaves[c].combine_chunks()).astype(np.int64) for c in ("lo", "hi")] if len(self.names) else [np.zeros((0, config.w), dtype=np.int64)] * 2
            self.low, self.high = self.bounds.ranges(*ends)
            self.kept: OrderedDict = OrderedDict()

        def rows_of(self, some: list[int]) -> tuple[np.ndarray, np.ndarray]:
            """(series_id, values) of the leaves; those not kept are read by one scan of each part that holds any of them."""
            wanted: dict = {}
            for i in some:
                if i in self.kept:
                    self.kept.move_to_end(i)
                else:
                    for p in self.parts[i]:
                        wanted.setdefault(p, []).append(i)
            found: dict = {i: [] for group in wanted.values() for i in group}
            for p, group in wanted.items():
                place = {self.names[i]: i for i in group}
                rows = ds.dataset(f"{self.place}/rows/part={p}", filesystem=self.store, format="parquet")
                got = rows.to_table(columns=["leaf_id", "series_id", "values"], filter=ds.field("leaf_id").isin(list(place))).combine_chunks()
                if not got.num_rows:
                    continue
                leaf = np.array([place[name] for name in got["leaf_id"].to_pylist()])
                order = np.argsort(leaf, kind="stable")
                ids, values = got["series_id"].to_numpy()[order], matrix_of(got["values"].combine_chunks())[order]
                which, start = np.unique(leaf[order], return_index=True)
                for i, a, b in zip(which.tolist(), start, [*start[1:], len(leaf)], strict=True):
                    found[i].append((ids[a:b].copy(), values[a:b].copy()))
            for i, pieces in found.items():
                self.kept[i] = tuple(np.concatenate(side) for side in zip(*pieces, strict=True)) if pieces else (np.zeros(0, dtype=np.int64), np.zeros((0, config.n)))
            ids, values = (np.concatenate(side) for side in zip(*(self.kept[i] for i in some), strict=True))
            held = sum(len(v[0]) for v in self.kept.values())
            while len(self.kept) > 1 and held > KEPT_ROWS:
                held -= len(self.kept.popitem(last=False)[1][0])
            return ids, values

        def eval(self, query, k):
            if query is None or k is None or k < 1 or len(query) != config.n or any(v is None or v != v for v in query):
                return
            x = np.array(query, dtype=float)
            if config.z_normalize:
                sd = x.std()
                x = (x - x.mean()) / (sd if sd >= 1e-8 else 1.0)
            vector = summary_of(x, config, model)
            lb = self.bounds.between(vector, vector, self.low, self.high)
            d, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
            order, lo, width = np.argsort(lb, kind="stable"), 0, FIRST_LEAVES
            while lo < len(order):
                some = order[lo : lo + width]
                some = some[: max(1, np.searchsorted(np.cumsum(self.sizes[some]), OPEN_ROWS, "right"))]
                if len(d) == k and not (lb[some] <= d[-1] * (1 + 1e-9) + 1e-9).any():
                    break
                lo, width = lo + len(some), 2 * width
                if len(d) == k:
                    some = some[lb[some] <= d[-1] * (1 + 1e-9) + 1e-9]
                more, values = self.rows_of(some.tolist())
                gap = values - x
                d, ids = np.concatenate([d, np.einsum("ij,ij->i", gap, gap)]), np.concatenate([ids, more])
                first = np.lexsort((ids, d))[:k]
                d, ids = d[first], ids[first]
            for rank, (series, dist) in enumerate(zip(ids.tolist(), d.tolist(), strict=True), 1):
                yield rank, series, dist

    spark.udtf.register(name, F.udtf(Knn, returnType="rank int, series_id long, dist double"))
