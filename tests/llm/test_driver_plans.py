"""What many short plans leave with the driver: few of them, and their native memory is given back."""

import pytest
from pyspark.sql import functions as F

from wavekin.llm import common, components, near_dedup


@pytest.fixture
def staged(monkeypatch):
    names, stage = [], common.stage

    def counted(df, name):
        names.append(name)
        return stage(df, name)

    for module in (common, components, near_dedup):
        monkeypatch.setattr(module, "stage", counted)
    return names


def test_stars_take_no_round(spark, staged):
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (21, 20), (7, 7)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(i, 0) for i in range(1, 9)] + [(21, 20)]
    assert staged == ["cc"]


@pytest.mark.parametrize("edges", [[(1, 0), (2, 1)], [(2, 0), (2, 1)], [(3, 2), (2, 1), (4, 0), (4, 3)]])
def test_what_is_not_a_star_is_seen(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    total, open_ = components._state(df)
    assert total == len(edges) and open_ > 0
    nodes = {n for e in edges for n in e}
    assert sorted(map(tuple, components.components(df).collect())) == [(n, 0) for n in sorted(nodes - {0})]


def test_copies_alone_search_for_no_further_pairs(spark, staged):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, words) for i in range(5)] + [(9, words + " end"), (11, "one two three four five six")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 0, 11: 11}
    # all buckets lie in one component, so nothing is left to compare or to join a second time
    assert staged.count("cc") == 1 and staged.count("links") == 1


def test_driver_gives_native_memory_back(spark, monkeypatch):
    assert "rim native heap" in common.trim_native(spark)
    given = []
    monkeypatch.setattr(common, "trim_native", given.append)
    common.stage(spark.range(3).select(F.col("id")), "few")
    common.tidy(spark)
    assert len(given) == 2
