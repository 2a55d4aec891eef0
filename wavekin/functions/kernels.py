"""Arrow-vectorised kernels for what native expressions cannot do, or not fast enough at volume."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, ShortType, StructField, StructType

from .arrays import breakpoints
from .distances import sfa_weights


#: Diagonals between two looks at which rows are over the limit, and the share of rows within it from which those over it stay.
DTW_LOOK, DTW_FULL = 8, 0.8


def dtw_limited(a: np.ndarray, b: np.ndarray, r: int, limit: float = np.inf, tail: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(squared-cost DTW within |i - j| <= r of each row of a with the same row of b, cells computed); rows found to exceed ``limit`` are infinite.

    ``b`` may have one row for all. Cells of one diagonal i + j do not need each other, so a
    diagonal is one step for all rows. A path has a cell on every second diagonal, so the
    smaller of two diagonals' minima, and what ``tail`` says about the values of a not yet
    used (row i: a bound of their part from i on), never exceeds its cost. Rows over the limit leave the block.
    """
    rows, n = a.shape
    out = np.full(rows, np.inf)
    if not rows:
        return out, 0
    at, one = np.arange(rows), b.shape[0] == 1
    x, y, used = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), 0
    # the cells of the last two diagonals between infinite neighbours, and the first's i; None for an empty one
    last, before = None, None
    cells, step, low_before = 0, 0, np.full(rows, np.inf)
    for d in range(2 * n - 1):
        lo, hi = max(0, d - n + 1, (d - r + 1) // 2), min(d, n - 1, (d + r) // 2)
        if lo > hi:
            # only with r = 0: every other diagonal is empty
            last, before = None, last
            continue
        now = np.empty((hi - lo + 3, len(at)))
        now[0] = now[-1] = np.inf
        gap = now[1:-1]
        np.subtract(x[lo - used : hi + 1 - used], y[d - hi : d - lo + 1][::-1], out=gap)
        gap *= gap
        best = None
        if last is not None:
            c, first = last
            best = np.minimum(c[lo - first : hi - first + 1], c[lo - first + 1 : hi - first + 2])
        if before is not None:
            c, first = before
            c = c[lo - first : hi - first + 1]
            best = c if best is None else np.minimum(best, c, out=best)
        if best is not None:
            gap += best
        cells += gap.size
        last, before = (now, lo), last
        step += 1
        if limit < np.inf and step % DTW_LOOK >= DTW_LOOK - 2:
            low = gap.min(axis=0)
            if step % DTW_LOOK == DTW_LOOK - 1:
                rest = tail[min((d + r) // 2 + 1, n)] if tail is not None else 0.0
                alive = np.minimum(low, low_before) + rest <= limit
                count = np.count_nonzero(alive)
                if not count:
                    return out, cells
                if count < DTW_FULL * len(at):
                    kept = np.flatnonzero(alive)
                    at, x, used = at[kept], x[lo - used :].take(kept, axis=1), lo
                    last, before = (last[0].take(kept, axis=1), last[1]), before and (before[0].take(kept, axis=1), before[1])
                    y = y if one else y.take(kept, axis=1)
                    tail = tail if tail is None else tail.take(kept, axis=1)
                    low = low[kept]
            low_before = low
    done = last[0][1]
    out[at] = np.where(done <= limit, done, np.inf)
    return out, cells


def dtw_block(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Squared-cost DTW within |i - j| <= r of each row of a with the same row of b."""
    return dtw_limited(a, b, r)[0]


def dtw(a: Column, b: Column, r: int) -> Column:
    """Banded DTW of two array columns of one length, squared; null where one of them is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        ok = np.array([u is not None and v is not None and len(u) == len(v) and len(u) > 0 for u, v in zip(x, y, strict=True)], dtype=bool)
        for n in {len(u) for u, k in zip(x, ok, strict=True) if k}:
            at = np.array([i for i in np.flatnonzero(ok) if len(x[i]) == n])
            out[at] = dtw_block(np.stack([x[i] for i in at]).astype(float), np.stack([y[i] for i in at]).astype(float), r)
        return pd.Series(out).where(ok, None)

    return run(a, b)


def matrix_of(column) -> np.ndarray:
    """An Arrow list column whose lists have one length as rows of doubles. Null elements become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_of(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def coefficients_of(x: np.ndarray, coefficients: list[int]) -> np.ndarray:
    """Interleaved (re, -im) of X_k / sqrt(n) for rows of x."""
    f = np.fft.rfft(x, axis=1)[:, coefficients] / np.sqrt(x.shape[1])
    out = np.empty((len(x), 2 * len(coefficients)))
    out[:, 0::2], out[:, 1::2] = f.real, -f.imag
    if 0 in coefficients:
        out[:, 2 * coefficients.index(0) + 1] = 0.0
    return out


def summarise(prepared: DataFrame, config, model=None) -> DataFrame:
    """Adds vector and word to rows with ``values``: PAA and SAX symbols, or Fourier values and SFA symbols.

    A map over batches, not a column: filters that Spark derives from a later explode
    must not be moved into a Python function's arguments.
    """
    w, m, n = config.w, config.segment, config.n
    bins = np.array(breakpoints(config.alphabet)) if config.summarization == "sax" else [np.array(b) for b in model.bins]
    chosen = None if config.summarization == "sax" else list(model.coefficients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("values"))
            if chosen is None:
                vector = x[:, : w * m].reshape(len(x), w, m).mean(axis=2)
                word = np.searchsorted(bins, vector, side="left")
            else:
                vector = coefficients_of(x, chosen)
                word = np.stack([np.searchsorted(b, np.round(vector[:, i], 6), side="right") for i, b in enumerate(bins)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(vector), lists_of(word.astype(np.int16))], [*batch.schema.names, "vector", "word"])

    schema = StructType([*prepared.schema.fields, StructField("vector", ArrayType(DoubleType())), StructField("word", ArrayType(ShortType()))])
    return prepared.mapInArrow(run, schema)


#: Rows and queries whose bounds are computed together, so that they stay in the cache.
NEAR_BLOCK = 32, 1024


class WordBounds:
    """Lower bounds of squared distances from symbol ranges, for one query at a time against many rows.

    Every segment has edges and a weight: segment length for SAX, Parseval weights for SFA.
    SFA bins come from values rounded to 6 decimals, so its gaps are shortened by ``slack``.
    """

    def __init__(self, config, model=None):
        if config.summarization == "sax":
            self.edges = np.tile([-np.inf, *breakpoints(config.alphabet), np.inf], (config.w, 1))
            self.weights, self.slack = np.full(config.w, float(config.segment)), 0.0
        else:
            self.edges = np.array([[-np.inf, *b, np.inf] for b in model.bins])
            self.weights, self.slack = np.array(sfa_weights(config.n, model.coefficients)), 1e-6

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper values of the symbol ranges lo .. hi, each rows x segments."""
        seg = np.arange(len(self.edges))
        return self.edges[seg, lo], self.edges[seg, hi + 1]

    def between(self, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bound of each row (low, high) for a query whose segments reach from ``least`` to ``most``; a plain query's are equal."""
        gap = np.maximum(np.maximum(low - most, least - high) - self.slack, 0.0)
        return (gap * gap) @ self.weights

    def near(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Where a row's bound (rows low, high) can be within a query's limit, rows x queries: in single precision, with a margin for it, so some more than there are."""
        edges = self.edges[:, 1:-1]
        size = max(np.abs(edges).max(initial=0.0), np.abs(vectors).max(initial=0.0))
        kind = np.float32 if size < 1e15 else np.float64
        slack = kind(self.slack + (4e-7 * size if kind is np.float32 else 0.0))
        with np.errstate(over="ignore"):
            limits = (limits * (1 + 1e-5)).astype(kind)
        low, high, v = (np.ascontiguousarray(x.T, dtype=kind) for x in (low, high, vectors))
        weights, out = self.weights.astype(kind), np.empty((low.shape[1], v.shape[1]), dtype=bool)
        tall, wide = NEAR_BLOCK
        for a in range(0, out.shape[0], tall):
            for c in range(0, out.shape[1], wide):
                x, least, most = v[:, c : c + wide], low[:, a : a + tall, None], high[:, a : a + tall, None]
                total = np.zeros((least.shape[1], x.shape[1]), dtype=kind)
                gap, other = np.empty_like(total), np.empty_like(total)
                for i, weight in enumerate(weights):
                    np.subtract(least[i], x[i], out=gap)
                    np.subtract(x[i], most[i], out=other)
                    np.maximum(gap, other, out=gap)
                    gap -= slack
                    np.maximum(gap, 0, out=gap)
                    np.multiply(gap, gap, out=gap)
                    gap *= weight
                    total += gap
                out[a : a + tall, c : c + wide] = total <= limits[c : c + wide]
        return out

    def centres(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distances of the middles of symbol ranges from all queries, ranges x queries, without the queries' own squares."""
        root, most = np.sqrt(self.weights), np.abs(self.edges[:, 1:-1]).max(axis=1)
        middle, v = (np.clip(low, -most, most) + np.clip(high, -most, most)) / 2 * root, np.clip(vectors, -most, most) * root
        return np.column_stack([-2 * middle, np.einsum("ij,ij->i", middle, middle)]) @ np.column_stack([v, np.ones(len(v))]).T

    def of_words(self, vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Bounds of all words for all queries' vectors, words x queries."""
        out = np.zeros((len(words), len(vectors)))
        for i, (edges, weight) in enumerate(zip(self.edges, self.weights, strict=True)):
            x = vectors[:, i]
            gap = np.maximum(np.maximum(edges[:-1, None] - x, x - edges[1:, None]) - self.slack, 0.0)
            gap *= gap
            gap *= weight
            out += gap[words[:, i]]
        return out


def envelopes(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest values at most r positions away, for every row."""
    lo, hi = x.copy(), x.copy()
    for s in range(1, min(r, x.shape[1] - 1) + 1):
        for f, side in ((np.minimum, lo), (np.maximum, hi)):
            f(side[:, s:], x[:, :-s], out=side[:, s:])
            f(side[:, :-s], x[:, s:], out=side[:, :-s])
    return lo, hi


def keogh_tail(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Row i: for every row of x the part of ``keogh`` that its values from i on have; row 0 is ``keogh``, the last row 0."""
    out = np.empty((x.shape[1] + 1, len(x)))
    out[-1] = 0.0
    x = np.ascontiguousarray(x.T)
    gap = x - np.clip(x, lo[:, None], hi[:, None])
    gap *= gap
    for i in range(len(x) - 1, -1, -1):
        np.add(out[i + 1], gap[i], out=out[i])
    return out


def keogh(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of the rows of x to one query's envelope."""
    gap = np.maximum(np.maximum(x - hi, lo - x), 0.0)
    return (gap * gap).sum(axis=1)
