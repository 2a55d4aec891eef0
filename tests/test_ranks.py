"""Exact ranks on skewed values."""

import numpy as np
from pyspark.sql import functions as F

from wavekin.operators import index as I
from wavekin.operators import learning as L
from wavekin.operators import relational as R


def test_far_and_frequent_values_make_no_large_cell(spark):
    rng = np.random.default_rng(61)
    x = np.concatenate([rng.normal(size=9000), [1e9, -1e12], np.zeros(4000), np.full(500, 0.25)])
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(1, 7.0)] * 10, "seg int, x double").persist()
    held = L.cells(df).groupBy("seg", "cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert held <= 9003 / 100
    got = sorted((r["x"], r["first"], r["n"]) for r in L.ranks(df.where("seg = 0")).collect())
    value, count = np.unique(x, return_counts=True)
    assert got == list(zip(value.tolist(), (np.cumsum(count) - count).tolist(), count.tolist(), strict=True))
    edges = {r["bin"]: r["edge"] for r in L.equi_depth(df.where("seg = 0"), 16).collect()}
    assert edges == {b: float(np.sort(x)[(b + 1) * len(x) // 16]) for b in range(15)}


def test_ranks_do_not_depend_on_the_order_of_the_rows(spark, monkeypatch):
    """Each evaluation meets its rows in another order, as behind a shuffle on a cluster."""
    def shuffled(batches):
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=np.random.default_rng().integers(1 << 31))

    monkeypatch.setattr(L, "CELLS", 64)
    monkeypatch.setattr(L, "BORDER_ACCURACY", 200)
    s = 60_000
    df = spark.range(s, numPartitions=3).select(F.lit(0).alias("seg"), (F.col("id") * 7919 % s).cast("double").alias("x"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["bin"]: r["edge"] for r in L.equi_depth(df.mapInPandas(shuffled, "seg int, x double"), 256).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {b: float((b + 1) * s // 256) for b in range(255)}


def test_percentiles_and_last_rows(spark):
    x = np.random.default_rng(62).integers(0, 40, size=333) / 4
    df = spark.createDataFrame([(i % 3, i, float(v)) for i, v in enumerate(x)] + [(5, 1000, None), (6, 1001, 2.5)], "k int, t int, v double")
    got = {r["k"]: (r["q1"], r["q2"], r["q3"]) for r in R.box(df, ["k"], "v").collect()}
    want = {k: tuple(np.percentile(x[k::3], p) for p in (25, 50, 75)) for k in range(3)} | {5: (None,) * 3, 6: (2.5,) * 3}
    assert got.keys() == want.keys() and all(got[k] == want[k] or np.allclose(got[k], want[k]) for k in got)
    assert sorted(r["t"] for r in R.drop_last(df, ["k"], "t").collect()) == list(range(330))


def test_coarsened_words_share_pages(spark):
    words = spark.createDataFrame([([i % 16, i // 16 % 4, 5],) for i in range(64)] * 2, "word array<int>")
    rounds = I.coarsen_rounds(words, 3, lambda pages, n: n == 4)
    assert [p for _, p in rounds] == [32, 16, 8, 4] and [s for s, _ in rounds] == [0, 0, 0, 0]
    pages = I.lay_out(words, [4, 0, 0], 2)
    assert pages.select("page_key").distinct().count() == 4
    assert pages.withColumn("p", F.spark_partition_id()).groupBy("page_key").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
