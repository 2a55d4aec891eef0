"""The SQL table function over a stored index, and totals of a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions.search_sql import register_knn
from wavekin.operators import search as S
from wavekin.operators.index import SeriesIndex
from wavekin.streaming.continuous import running_history


@pytest.mark.parametrize("settings", [{}, {"summarization": "sfa", "split": "cyclic"}])
def test_table_function_equals_search(spark, tmp_path, settings):
    x = np.random.default_rng(51).normal(size=(200, 32)).cumsum(axis=1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>").persist()
    path = str(tmp_path / "i")
    index = SeriesIndex.build(df.where("series_id < 120"), SeriesConfig(n=32, w=8, leaf_size=9, **settings), path=path, part_rows=40).append(df.where("series_id >= 120"))
    register_knn(spark, path, "nearest")
    asked = df.where("series_id % 40 = 0").select(F.col("series_id").alias("q_id"), "values")
    asked.createOrReplaceTempView("asked")
    got = {(r["q_id"], r["rank"]): (r["series_id"], round(r["dist"], 9)) for r in spark.sql("SELECT q_id, n.* FROM asked, LATERAL nearest(values, 4) n").collect()}
    want = {(r["q_id"], r["rank"]): (r["series_id"], round(r["dist"], 9)) for r in S.knn(index, asked, 4, exclude_self=False).collect()}
    assert got == want and len(got) == 20
    odd = spark.sql("SELECT n.* FROM VALUES (CAST(NULL AS ARRAY<DOUBLE>)), (array(1D)), (array_repeat(CAST('NaN' AS DOUBLE), 32)) AS t(v), LATERAL nearest(v, 3) n")
    assert odd.count() == 0


def test_leaves_are_read_in_blocks_not_one_by_one(spark, tmp_path, monkeypatch):
    from wavekin.functions import search_sql

    x = np.random.default_rng(52).normal(size=(600, 16))
    series = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>")
    path, classes, scans, real = str(tmp_path / "i"), [], [], F.udtf
    index = SeriesIndex.build(series, SeriesConfig(n=16, w=8, leaf_size=5, z_normalize=False), path=path, part_rows=300)
    monkeypatch.setattr(search_sql.F, "udtf", lambda c, returnType: classes.append(c) or real(c, returnType=returnType))
    register_knn(spark, path, "blocks")
    monkeypatch.undo()
    dataset = search_sql.ds.dataset
    monkeypatch.setattr(search_sql.ds, "dataset", lambda *a, **more: scans.append(a) or dataset(*a, **more))
    got = [(r[1], round(r[2], 9)) for r in classes[0]().eval(x[4].tolist(), 600)]
    d = ((x - x[4]) ** 2).sum(axis=1)
    assert got == [(int(i), round(float(d[i]), 9)) for i in np.argsort(d)]
    assert index.leaves.count() > 100 and len(scans) < 30


def test_running_totals_are_exact_and_survive_a_restart(spark, tmp_path):
    rows = [(q, int(q * 7 % 50), s) for s in range(3) for q in range(s, 300, s + 1)]
    df = spark.createDataFrame(rows, "q_id long, latency long, step long")
    for step in range(3):
        df.where(F.col("step") == step).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        running_history(stream, str(tmp_path / "out"), str(tmp_path / "mark"), availableNow=True).awaitTermination()
    got = sorted((r["step"], r["queries"], r["answers"], r["avg_latency"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for step in range(3):
        some = [r for r in rows if r[2] <= step]
        want.append((step, len({r[0] for r in some}), len(some), sum(r[1] for r in some) / len(some)))
    assert got == want
