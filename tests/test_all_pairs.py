"""Measures of all pairs of rows and queries."""

import numpy as np
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions import distances as D
from wavekin.operators import search as S
from wavekin.operators.index import SeriesIndex


def test_all_pairs_meet_in_batches_and_odd_rows_by_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_OUT", 50)
    monkeypatch.setattr(S, "QUERY_BYTES", 200)
    x = np.random.default_rng(71).normal(size=(60, 4)).tolist()
    x[3], x[7], x[20], x[30] = [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], None
    rows = spark.createDataFrame(list(enumerate(x)), "series_id long, values array<double>")
    asked = rows.where("series_id % 10 = 0").select(F.col("series_id").alias("q_id"), F.col("values").alias("q"))
    dist = D.l2sq(F.col("values"), F.col("q"))
    pairs = S.all_pairs(rows, asked, {"values": 4, "q": 4}, S.l2_kernel, {"dist": dist})
    # the pairs go by batches; only rows that no matrix can hold meet the queries in a join
    plan = pairs._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
    got = {(r["q_id"], r["series_id"]): r["dist"] for r in pairs.collect()}
    want = {(r["q_id"], r["series_id"]): r["dist"] for r in rows.crossJoin(asked).where("series_id <> q_id").select("q_id", "series_id", dist.alias("dist")).collect()}
    assert got.keys() == want.keys() and len(got) == 6 * 59
    assert all((got[k] is None) == (v is None) and (v is None or np.isclose(got[k], v, rtol=1e-12, equal_nan=True)) for k, v in want.items())


def test_tight_bounds_compare_words_once(spark):
    """Copies of a series have one word: the queries meet it once, whatever the number of copies."""
    x = np.random.default_rng(72).normal(size=(20, 8)).cumsum(axis=1)
    series = spark.createDataFrame([(i, x[i % 20].tolist()) for i in range(600)], "series_id long, values array<double>")
    index = SeriesIndex.build(series, SeriesConfig(n=8, w=4, bits=4, leaf_size=1 << 40))
    q = S.prepare_queries(index, series.where("series_id % 100 = 0").select(F.col("series_id").alias("q_id"), "values"))
    held = S.tight_bounds(index, q)
    found = {(r["q_id"], r["root_key"]): r["lb"] for r in held.collect()}
    both = index.rows.crossJoin(q.select("q_id", "q_vector")).select("q_id", "root_key", S.record_bound(index, F.col("q_vector"), F.col("word")).alias("lb"))
    want = {(r["q_id"], r["root_key"]): r["lb"] for r in both.groupBy("q_id", "root_key").agg(F.min("lb").alias("lb")).collect()}
    assert found.keys() == want.keys() and all(np.isclose(found[k], v, atol=1e-12) for k, v in want.items())
