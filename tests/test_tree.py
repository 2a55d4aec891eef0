"""Appending with splits, places of words, and leaves cut from sorted words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions import arrays as A
from wavekin.operators import index as I
from wavekin.operators import search as S
from wavekin.operators import tree as T


@pytest.fixture(scope="module")
def walks(spark):
    x = np.random.default_rng(31).normal(size=(360, 32)).cumsum(axis=1)
    x[200:240] = x[5]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>").persist()


def table(index):
    return sorted((r["leaf_id"], r["path"], r["n_rows"], r["depth"], tuple(r["cardinality"]), tuple(r["lo"]), tuple(r["hi"])) for r in index.leaves.collect())


def asked(df):
    return df.where("series_id % 60 = 0").select(F.col("series_id").alias("q_id"), "values")


CYCLIC = SeriesConfig(n=32, w=4, bits=4, leaf_size=12, split="cyclic")


def test_appended_tree_equals_a_rebuilt_one(walks, tmp_path):
    whole = I.SeriesIndex.build(walks, CYCLIC)
    grown = I.SeriesIndex.build(walks.where("series_id < 90"), CYCLIC)
    stored = I.SeriesIndex.build(walks.where("series_id < 90"), CYCLIC, path=str(tmp_path / "i"))
    for lo, hi in ((90, 100), (100, 300), (300, 360)):
        step = walks.where(F.col("series_id").between(lo, hi - 1))
        grown, stored = grown.append(step), stored.append(step)
    assert table(grown) == table(stored) == table(whole)
    assert max(r["n_rows"] for r in whole.leaves.collect()) >= 41  # equal series cannot be parted
    for index in (grown, stored):
        assert sorted(map(tuple, index.rows.select("series_id", "leaf_id").collect())) == sorted(map(tuple, whole.rows.select("series_id", "leaf_id").collect()))
        assert sorted(map(tuple, S.knn(index, asked(walks), 3).collect())) == sorted(map(tuple, S.knn(whole, asked(walks), 3).collect()))
    unchanged = grown.append(walks.limit(0))
    assert table(unchanged) == table(whole)
    grown.release()


@pytest.mark.parametrize("rule", ["variance", "informed", "round-robin"])
def test_leaves_keep_their_size_under_every_rule(walks, rule):
    config = SeriesConfig(n=32, w=4, leaf_size=12, split=rule)
    index = I.SeriesIndex.build(walks.where("series_id < 100"), config).append(walks.where("series_id >= 100"))
    held = index.rows.groupBy("leaf_id").agg(F.count("*").alias("n"), F.count_distinct(A.packed_hex(F.col("word"))).alias("words"))
    assert held.where("n > 12 and words > 1").count() == 0
    assert held.agg(F.sum("n")).first()[0] == 360 == index.leaves.agg(F.sum("n_rows")).first()[0]
    # every row's word lies in its leaf
    both = index.rows.select("leaf_id", "word").join(index.leaves.select("leaf_id", "cardinality"), "leaf_id")
    assert both.where(A.leaf_label(F.col("word"), F.col("cardinality"), 8) != F.col("leaf_id")).count() == 0
    assert sorted(map(tuple, S.knn(index, asked(walks), 2).collect())) == sorted(map(tuple, S.knn(I.SeriesIndex.build(walks, config), asked(walks), 2).collect()))


def test_an_append_that_did_not_finish_does_not_count(walks, spark, tmp_path):
    path = str(tmp_path / "i")
    index = I.SeriesIndex.build(walks.where("series_id < 90"), CYCLIC, path=path)
    before = table(index)
    # rows are there, the commit is not
    I.SeriesIndex._write_rows(index.rows.join(index.leaves.select("leaf_id", "cardinality", "depth", "path"), "leaf_id"), path, 1)
    again = index.append(walks.where("series_id between 90 and 99"))
    assert again.rows.count() == 100 == again.leaves.agg(F.sum("n_rows")).first()[0]
    assert before != table(again)


def test_places_by_broadcast_and_by_shuffle(walks, monkeypatch):
    index = I.SeriesIndex.build(walks.where("series_id < 150"), CYCLIC)
    worded = I.SeriesIndex.summarise(I.SeriesIndex.prepare(walks, CYCLIC), CYCLIC, None).withColumn("word_key", A.packed_hex(F.col("word")))
    words = worded.groupBy("root_key", "word_key").agg(F.first("word").alias("word")).persist()
    shown = lambda: sorted((r["word_key"], r["leaf_id"] or "", r["path"], tuple(r["cardinality"]), r["depth"]) for r in T.place(words, index.leaves, CYCLIC).collect())
    want = shown()
    assert any(not r[1] for r in want) and len(want) == words.count()
    monkeypatch.setattr(T, "BROADCAST_LEAVES", 0)
    assert shown() == want


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_leaves_cut_from_sorted_words_equal_split_ones(walks, limit):
    worded = I.SeriesIndex.summarise(I.SeriesIndex.prepare(walks, CYCLIC), CYCLIC, None).withColumn("word_key", A.packed_hex(F.col("word")))
    words = worded.groupBy("root_key", "word_key").agg(F.first("word").alias("word"), F.count("*").alias("count")).persist()
    shown = lambda t: sorted((r["word_key"], r["leaf_id"], tuple(r["cardinality"]), r["depth"], r["path"]) for r in t.collect())
    assert shown(T.leaf_of_sorted(words, CYCLIC, limit)) == shown(I.leaf_of_words(words, CYCLIC))
    with pytest.raises(ValueError, match="cyclic"):
        T.leaf_of_sorted(words, SeriesConfig(n=32, w=4), 10)
