"""The hash-prefix forest on vectors with and without clusters."""

import numpy as np
from pyspark.sql import functions as F

from wavekin.llm import ann


def clustered(rows, dim, clusters, rng):
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, rows)] + 0.35 * rng.standard_normal((rows, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clustered_vectors_need_a_fraction_of_the_rows():
    rng = np.random.default_rng(12)
    x = clustered(8000, 48, 400, rng)
    strings = ann.hash_strings(np.hstack([x, np.zeros((len(x), 1))]), ann.directions(49))
    forest = ann.Forest.plant(strings)
    asked = np.arange(0, 8000, 40)
    hits, looked = [], []
    for q, rows in zip(asked, forest.candidates(strings[asked], 800), strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score, kind="stable")[:20])
        hits.append(len(best & set(rows)) / 20)
        looked.append(len(rows) / len(x))
    assert np.mean(hits) >= 0.9 and np.mean(looked) <= 0.25, (np.mean(hits), np.mean(looked))


def test_recall_on_the_test_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).toPandas()
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    hits = []
    for q, found in got.groupby("query_id"):
        score = x @ x[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        best = ids[keep][np.lexsort((ids[keep], -score[keep]))[:20]]
        hits.append(len(set(best) & set(found["vec_id"])) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_blocks_of_queries_and_clashing_columns_change_nothing(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((300, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df.withColumns({c: F.lit(1) for c in ("v", "segment", "query_id", "score", "rank", "strings", "block")})
    asked = lambda t: t.where("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.nearest(df, asked(df), 5).collect()))
    assert sorted(map(tuple, ann.nearest(wide, asked(wide), 5).collect())) == want
    index_rows = ann._usable(df, "vec_id", "embedding")
    index = ann.build_index(index_rows, 8, 10.0, 2)
    q = index_rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    one = sorted(map(tuple, ann.search(index, q, 8, 5).collect()))
    assert sorted(map(tuple, ann.search(index, q, 8, 5, query_bytes=600).collect())) == one
