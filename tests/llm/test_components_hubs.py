"""Components and counted joins around hubs, against union-find and the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from wavekin.llm import common
from wavekin.llm.components import components


def _roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_with_hubs(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    draw = random.Random(hot)
    # a hub with the smallest id, one with the largest, a path, random edges, loops and repeats
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)]
    edges += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(5, 5), (0, 1), (159, 200)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == _roots(edges)


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_counted_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select((F.least(F.col("id") % 50, F.lit(20)) * F.when(F.col("id") % 7 > 0, 1)).alias("k"), "id")
    values = rows.where("k <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.join_counted(rows, values, "k", "n", 500)
    assert got.columns == ["k", "id", "n", "top"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(values, "k").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_rounds_give_back_their_plans(spark, monkeypatch):
    """A driver that keeps the plans of all rounds grows until its heap is full."""
    from wavekin.llm import components as C

    freed = []
    monkeypatch.setattr(C, "tidy", lambda s: freed.append(s), raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    assert sorted(tuple(r) for r in C.components(edges).collect()) == [(i, 0) for i in range(1, 10)]
    assert len(freed) >= 2


def test_hot_keys_of_a_counted_join_are_split(spark, monkeypatch):
    """The values of hot keys were joined from the left, which passed every row through a second join."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id")
        got = common.join_counted(rows, rows.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 20_000)
        assert got.agg(F.count("*"), F.max("n")).first() == (20_000, 10_040)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan and "LeftOuter" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
