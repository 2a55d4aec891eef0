"""Searches without a table of open pairs: rows in passing, leaves of smallest bound, windows of a walk cut by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions.kernels import WordBounds
from wavekin.operators import search as S
from wavekin.operators.index import SeriesIndex
from wavekin.plans import fixtures as X


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 32)).cumsum(axis=1)[rng.integers(20, size=500)] + rng.normal(size=(500, 32)) * 0.4).cumsum(axis=1)
    x[31], x[32] = x[30], x[30]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>").persist(), x


ASKED = (0, 30, 31, 402)


def asked(df):
    return df.where(F.col("series_id").isin(*ASKED)).select(F.col("series_id").alias("q_id"), "values")


def nearest(x, q, k):
    d = ((x - x[q]) ** 2).sum(axis=1)
    d[q] = np.inf
    return [(int(i), round(float(d[i]), 6)) for i in np.lexsort((np.arange(len(d)), np.round(d, 9)))[:k]]


def found(df):
    got = {}
    for r in df.orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["series_id"], round(r["dist"], 6)))
    return got


@pytest.mark.parametrize("settings", [{}, {"summarization": "sfa"}, {"z_normalize": False}])
@pytest.mark.parametrize("strategy", ["tree", "scan"])
def test_rows_in_passing_have_the_answers_of_a_full_search(walks, settings, strategy, monkeypatch):
    df, x = walks
    z = x if settings.get("z_normalize") is False else (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    index = SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=10, **settings))
    monkeypatch.setattr(S, "open_leaves", None)
    monkeypatch.setattr(S, "_answers", None)
    for products in (40, S.PRODUCTS):
        monkeypatch.setattr(S, "PRODUCTS", products)
        assert found(S.knn(index, asked(df), 5, strategy=strategy)) == {q: nearest(z, q, 5) for q in ASKED}
    # no limit at all: every run of rows gives its k nearest
    every = asked(df).select("q_id", F.lit(float("inf")).alias("bsf"))
    assert found(S.knn(index, asked(df), 5, strategy=strategy, bsf=every)) == {q: nearest(z, q, 5) for q in ASKED}
    index.release()


def test_a_stored_index_is_searched_in_passing_by_its_open_parts(walks, tmp_path, monkeypatch):
    df, x = walks
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    index = SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=10), path=str(tmp_path / "index"), part_rows=50)
    monkeypatch.setattr(S, "open_leaves", None)
    assert found(S.knn(index, asked(df), 3)) == {q: nearest(z, q, 3) for q in ASKED}


def test_rows_of_a_leaf_lie_together_after_append_and_complete(walks, tmp_path):
    df, _ = walks
    config = SeriesConfig(n=32, w=8, leaf_size=10)
    grown = SeriesIndex.build(df.where("series_id < 100"), config).append(df.where("series_id >= 100"))
    SeriesIndex.build(df, config).save(str(tmp_path / "bare"), covering=False)
    completed = SeriesIndex.load(df.sparkSession, str(tmp_path / "bare")).complete(df)
    for index in (grown, completed):
        leaves = [r["leaf_id"] for r in index.rows.select("leaf_id").collect()]
        runs = 1 + sum(a != b for a, b in zip(leaves[:-1], leaves[1:], strict=True))
        assert len(leaves) == 500 and runs <= 2 * len(set(leaves))
    grown.release()


def test_pruning_in_passing_counts_the_same(walks, monkeypatch):
    df, _ = walks
    index = SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=10))
    rows = lambda: sorted(map(tuple, S.pruning(index, asked(df), 3).collect()))
    want = rows()
    monkeypatch.setattr(S, "open_leaves", None)
    monkeypatch.setattr(S, "_open_pairs", lambda *_: np.inf)
    assert rows() == want and len(want) == len(ASKED)
    index.release()


def test_single_precision_closes_no_range_that_is_open():
    rng = np.random.default_rng(9)
    bounds = WordBounds(SeriesConfig(n=32, w=8))
    for size in (1.0, 1e7, 1e20):
        v, word = rng.normal(size=(300, 8)) * size, rng.integers(0, 256, size=(200, 8))
        low, high = bounds.ranges(np.maximum(word - 9, 0), word)
        lb = np.stack([bounds.between(x, x, low, high) for x in v], axis=1)
        limits = np.array([lb[rng.integers(200), j] for j in range(300)])
        near = bounds.near(v, low, high, limits)
        assert near[lb <= limits].all()
        assert size > 1 or near.sum() < 1.01 * (lb <= limits).sum()
        assert bounds.near(v, low, high, np.full(300, np.inf)).all()


def test_leaves_of_smallest_bound(monkeypatch):
    rng = np.random.default_rng(10)
    bounds = WordBounds(SeriesConfig(n=32, w=8))
    v, word = rng.normal(size=(20, 8)), rng.integers(60, 200, size=(700, 8))
    word[400] = word[300]
    low, high = bounds.ranges(word - 9, word)
    m = S.Euclid(S.QuerySet(np.arange(20), v, v), bounds)
    lb = np.stack([bounds.between(x, x, low, high) for x in v], axis=1)
    for products, count in ((1 << 21, 5), (700, 5), (1 << 21, 699)):
        monkeypatch.setattr(S, "PRODUCTS", products)
        got = {j: [] for j in range(20)}
        for js, place, _ in S._smallest(m, low, high, count):
            for j, p in zip(js, place, strict=True):
                got[j].append(p)
        order = [np.lexsort((np.arange(700), lb[:, j])) for j in range(20)]
        assert all(got[j] == order[j][:count].tolist() for j in range(20))
        # what comes behind the third, within the limit of the eighth
        after = np.array([lb[o[2], j] for j, o in enumerate(order)]), np.array([o[2] for o in order])
        limits = np.array([lb[o[7], j] for j, o in enumerate(order)])
        got = {j: [] for j in range(20)}
        for js, place, _ in S._smallest(m, low, high, count, limits, after):
            for j, p in zip(js, place, strict=True):
                got[j].append(p)
        assert all(got[j] == order[j][3 : min(8, 3 + count)].tolist() for j in range(20))


def test_a_step_of_a_walk_goes_to_one_block_or_two(spark, tmp_path, monkeypatch):
    value = [round(float(v), 3) for v in np.random.default_rng(3).exponential(50, size=1500)]
    spark.createDataFrame(list(enumerate(value)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(X, "WINDOWS", 20)
    k = np.array([round(v * 1000) for v in value])
    total = (k - k.sum() // len(k)).cumsum()
    want = {i // X.STRIDE: (total[i : i + X.N] / 1000).tolist() for i in range(0, len(k) - X.N + 1, X.STRIDE)}
    walk = X.walk(spark, str(tmp_path))
    assert {r["series_id"]: r["values"] for r in walk.collect()} == want
    spread = spark.createDataFrame([(i,) for i in range(1500)], "i long").select(F.explode(X.blocks_of(F.col("i"))).alias("b"))
    assert spread.count() < 2 * 1500 and spread.groupBy("b").count().agg(F.max("count")).first()[0] <= 20 * X.STRIDE + X.N - X.STRIDE
    walk.unpersist()
