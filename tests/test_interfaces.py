"""The index object, SQL functions, sources and sinks beside data, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions import arrays as A
from wavekin.functions import distances as D
from wavekin.functions import sql
from wavekin.functions.kernels import dtw_block, envelopes
from wavekin.operators import index as I
from wavekin.operators import learning as L
from wavekin.operators import relational as R
from wavekin.operators import search as S
from wavekin.sources import logs, matrix
from wavekin.streaming import continuous


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 32)).cumsum(axis=1)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>").persist(), x


def queries(df, every=50):
    return df.where(F.col("series_id") % every == 0).select(F.col("series_id").alias("q_id"), "values")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_stored_index_reads_only_the_parts_of_open_leaves(walks, tmp_path, monkeypatch):
    df, _ = walks
    monkeypatch.setattr(I, "PART_ROWS", 40)
    config = SeriesConfig(n=32, w=8, leaf_size=20)
    stored = I.SeriesIndex.build(df, config, path=str(tmp_path / "index"))
    held = I.SeriesIndex.build(df, config)
    assert stored.rows.select("part").distinct().count() == 10
    asked = queries(df, 200)
    assert rows(S.knn(stored, asked, 3)) == rows(S.knn(held, asked, 3))
    measure = S._measure(stored, next(S.query_blocks(S.prepare_queries(stored, asked))))
    few = S._rows_of(stored, S.near_leaves(stored, measure, 1))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert few.select("part").distinct().count() < 10
    held.release()


def test_methods_of_the_index(walks):
    df, x = walks
    index = I.SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=30))
    asked = queries(df)
    assert rows(index.nn(asked)) == rows(S.knn(index, asked, 1))
    assert rows(index.approx(asked, 2)) == rows(S.approximate(index, asked, 2))
    labels = df.select("series_id", (F.col("series_id") % 2).alias("label"))
    assert rows(index.classify(asked, labels, 3)) == rows(S.vote(S.knn(index, asked, 3), labels))
    again = I.SeriesIndex(index.config, None, index.rows.drop("values", "vector"), index.leaves).complete(df)
    assert rows(again.knn(asked, 2)) == rows(index.knn(asked, 2))
    assert rows(index.knn(asked, 2, min_leaves=1)) == rows(index.knn(asked, 2, strategy="scan"))


def test_queries_in_several_blocks(walks, monkeypatch):
    df, _ = walks
    index = I.SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=30))
    want = rows(S.knn(index, queries(df), 2)), rows(S.within(index, queries(df), 4.0)), rows(S.approximate(index, queries(df)))
    monkeypatch.setattr(S, "QUERY_BYTES", 900)
    assert (rows(S.knn(index, queries(df), 2)), rows(S.within(index, queries(df), 4.0)), rows(S.approximate(index, queries(df)))) == want
    monkeypatch.setattr(S, "OPEN_BYTES", 0)
    assert rows(S.knn(index, queries(df), 2)) == want[0]
    assert S.knn(index, queries(df).limit(0), 2).count() == 0


@pytest.mark.parametrize("rule", ["variance", "informed", "round-robin"])
def test_large_nodes_are_split_alike_by_spark(walks, rule):
    df, _ = walks
    config = SeriesConfig(n=32, w=4, leaf_size=8, split=rule)
    worded = I.SeriesIndex.summarise(I.SeriesIndex.prepare(df, config), config, None).withColumn("word_key", A.packed_hex(F.col("word")))
    words = worded.groupBy("root_key", "word_key").agg(F.first("word").alias("word"), F.count("*").alias("count")).persist()
    shown = lambda t: sorted((r["word_key"], r["leaf_id"], tuple(r["cardinality"]), r["depth"]) for r in t.collect())
    assert shown(I.leaf_of_words(words, config, limit=20)) == shown(I.leaf_of_words(words, config))


def test_dtw_search_equals_brute_force(walks):
    df, x = walks
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    index = I.SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=20))
    for strategy in ("tree", "scan"):
        for r in S.dtw_nearest(index, queries(df, 100), 3, strategy=strategy).collect():
            d = dtw_block(z, np.broadcast_to(z[r["q_id"]], z.shape), 3)
            d[r["q_id"]] = np.inf
            assert r["series_id"] == d.argmin() and abs(r["dist"] - d.min()) < 1e-9


def test_envelopes_equal_the_expression(walks, spark):
    df, x = walks
    lo, hi = envelopes(x[:5], 4)
    got = df.where("series_id < 5").orderBy("series_id").select(A.envelope(F.col("values"), 4).alias("e")).collect()
    assert np.allclose(lo, [[p["lo"] for p in r["e"]] for r in got]) and np.allclose(hi, [[p["hi"] for p in r["e"]] for r in got])


def test_equi_depth_edges_are_ranks(spark):
    rng = np.random.default_rng(3)
    data = {0: rng.normal(size=999).round(2), 1: np.zeros(50), 2: rng.exponential(size=7)}
    df = spark.createDataFrame([(s, float(v)) for s, x in data.items() for v in x], "seg int, x double")
    got = {(r["seg"], r["bin"]): r["edge"] for r in L.equi_depth(df, 16).collect()}
    assert got == {(s, b): float(np.sort(x)[(b + 1) * len(x) // 16]) for s, x in data.items() for b in range(15)}


def test_sql_functions(walks, spark):
    df, _ = walks
    config = SeriesConfig(n=32, w=8, bits=4, summarization="sfa", z_normalize=False)
    model = L.learn(df, config)
    names = sql.register(spark, config, model, band=2)
    assert names == ["l2sq", "znorm", "paa", "sax_word", "dtw", "sfa_word"]
    df.createOrReplaceTempView("walks")
    got = spark.sql("SELECT a.series_id, l2sq(a.values, b.values) d, znorm(a.values) z, paa(a.values) p, sax_word(a.values) s, dtw(a.values, b.values) w, sfa_word(a.values) f, dtw(a.values, array(1D)) bad FROM walks a JOIN walks b ON b.series_id = a.series_id + 1 WHERE a.series_id < 20")
    v, q = F.col("values"), F.col("q")
    both = df.join(df.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("q")), "series_id").where("series_id < 20")
    words = {r["series_id"]: r["word"] for r in I.SeriesIndex.summarise(I.SeriesIndex.prepare(df, config), config, model).collect()}
    want = {r["series_id"]: r for r in both.select("series_id", D.l2sq(v, q).alias("d"), A.znorm(v).alias("z"), A.paa(v, 8, 32).alias("p"), A.sax_word(A.paa(v, 8, 32), 16).alias("s"), "values", "q").collect()}
    assert got.count() == 20
    for r in got.collect():
        w = want[r["series_id"]]
        assert np.isclose(r["d"], w["d"]) and np.allclose(r["z"], w["z"]) and np.allclose(r["p"], w["p"]) and r["s"] == w["s"] and r["f"] == words[r["series_id"]] and r["bad"] is None
        assert np.isclose(r["w"], dtw_block(np.array([w["values"]]), np.array([w["q"]]), 2)[0])


def test_labels_beside_a_matrix(spark, tmp_path):
    np.arange(100, 112, dtype="<i8").tofile(tmp_path / "labels.bin")
    assert rows(matrix.read_labels(spark, str(tmp_path / "labels.bin"), 5)) == [(i, 100 + i) for i in range(5)]
    assert rows(matrix.read_labels(spark, f"file://{tmp_path}/labels.bin")) == [(i, 100 + i) for i in range(12)]
    assert matrix.read_remote(spark, str(tmp_path / "labels.bin"), 1, "int64", rows=3).count() == 3
    with pytest.raises(Exception, match="missing.bin"):
        matrix.read_matrix(spark, str(tmp_path / "missing.bin"), 4).count()


def test_logs_round_trip(walks, spark, tmp_path):
    df, _ = walks
    index = I.SeriesIndex.build(df, SeriesConfig(n=32, w=8, leaf_size=30))
    folder = str(tmp_path / "logs" / "walks" / "4")
    logs.write_index_logs(index, folder)
    logs.write_query_log(S.knn(index, queries(df)), S.pruning(index, queries(df)), folder)
    assert R.read_logs(spark, f"{folder}/query", "q_id long, distance double, rows double, pruned double, needed double").where("q_id is null").first()["rows"] == 399
    assert spark.read.option("header", True).csv(f"{folder}/query").count() == 9
    assert spark.read.option("header", True).csv(f"{folder}/index").first()["records"] == "400"
    assert dict(rows(spark.read.option("header", True).csv(f"{folder}/settings")))["leaf_size"] == "30"
    assert spark.read.option("header", True).csv(f"{folder}/tree").count() == 1


def test_generated_queries_are_answered_and_seen_in_views(walks, spark, tmp_path):
    df, _ = walks
    stream = continuous.generated_queries(spark, 32, per_second=20)
    assert stream.isStreaming
    run = continuous.answer_stream(stream, continuous.searcher(df, k=2), str(tmp_path / "out"), str(tmp_path / "mark"), processingTime="1 second")
    try:
        for _ in range(60):
            run.awaitTermination(1)
            if sum(p["numInputRows"] for p in run.recentProgress) >= 5:
                break
    finally:
        run.stop()
    continuous.register_views(spark, str(tmp_path / "out"))
    total = spark.sql("SELECT * FROM stats").first()
    assert total["answers"] == 2 * total["queries"] > 0
    assert spark.sql("SELECT sum(answers) FROM history").first()[0] == total["answers"]
