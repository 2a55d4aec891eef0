import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from wavekin.plans import catalog
from wavekin.sources import matrix, text


def test_matrix_round_trip(spark, tmp_path):
    x = np.arange(60, dtype=float).reshape(12, 5)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>")
    matrix.register(spark)
    for dtype in ("float32", "uint8", "int8", "int64"):
        path = str(tmp_path / dtype)
        matrix.write_matrix(df, path, dtype, rows_per_file=5)
        read = spark.read.format("series_matrix").option("path", path).option("n", 5).option("dtype", dtype).load()
        assert {r["series_id"]: r["values"] for r in read.collect()} == dict(enumerate(x.tolist()))
        remote = matrix.read_remote(spark, path, 5, dtype)
        assert {r["series_id"]: r["values"] for r in remote.collect()} == dict(enumerate(x.tolist()))


def test_matrix_tail_and_limit(spark, tmp_path):
    path = tmp_path / "one.bin"
    path.write_bytes(np.arange(11, dtype="<f4").tobytes())
    matrix.register(spark)
    reader = lambda: spark.read.format("series_matrix").option("path", str(path)).option("n", 4)
    assert reader().load().count() == 2
    assert reader().option("rows", 1).load().count() == 1
    with pytest.raises(Exception, match="3 rows are asked for"):
        reader().option("rows", 3).load().count()


def test_text_series(spark):
    lines = spark.createDataFrame([("2 1.5  2",), ("1",)], "value string")
    assert [(r["label"], r["values"]) for r in text.parse_labelled(lines, "value").collect()] == [(2, [1.5, 2.0]), (1, [])]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["prj_mean_std", "prj_paa_uneven", "prj_sax_word", "dst_dtw", "lbd_sax_odd", "qry_knn_bruteforce", "qry_knn_classify", "rel_average_rank", "rel_box"])
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    wanted = want.fetchall()
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = catalog.queries()[name](spark, small)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in wanted)


def test_stream_equals_batch(spark, small):
    q = catalog.queries()
    rows = lambda n: sorted(map(tuple, q[n](spark, small).collect()))
    assert rows("str_knn_available_now") == rows("qry_knn_bruteforce")
