"""Cells of a few groups' doubles: in Python with the borders in every task, as by columns."""

import numpy as np
from pyspark.sql import functions as F

from wavekin.operators import learning as L


def test_cells_are_those_by_columns_and_no_row_carries_borders(spark, monkeypatch):
    rng = np.random.default_rng(63)
    rows = [(i % 3, float(v)) for i, v in enumerate(np.round(rng.normal(size=4000), 2))] + [(0, None), (1, float("nan")), (2, float("inf")), (4, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "seg int, x double").repartition(3)
    monkeypatch.setattr(L, "CELLS", 64)
    key = lambda t: sorted(map(str, t.collect()))
    plan = L.cells(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "borders" not in plan
    quick = key(L.cells(df))
    monkeypatch.setattr(L, "_cells_of", None)
    grouped = L.cells(df.select(F.struct("seg").alias("seg"), "x")).select("seg.seg", "x", "n", "s", "cell")
    assert quick == key(grouped.where("seg is not null")) and len(quick) > 500
