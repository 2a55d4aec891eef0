import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.config import SeriesConfig
from wavekin.functions import arrays as A
from wavekin.functions import distances as D
from wavekin.functions.kernels import coefficients_of, dtw_block
from wavekin.operators.index import choose_segment, split_words


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 50)).cumsum(axis=1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(40, [1.0] * 50)]
    return spark.createDataFrame(rows, "series_id long, values array<double>"), np.vstack([x, np.ones((1, 50))])


def column(df, expression):
    return np.array([r[0] for r in df.orderBy("series_id").select(expression).collect()], dtype=float)


def z(x):
    sd = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(sd < 1e-8, 1, sd)


def test_znorm_paa_and_constant_series(series):
    df, x = series
    assert np.allclose(column(df, A.znorm(F.col("values"))), z(x))
    assert np.allclose(column(df, A.paa(F.col("values"), 16, 50)), x[:, :48].reshape(-1, 16, 3).mean(axis=2))
    parts = [p.mean(axis=1) for p in np.array_split(x, 16, axis=1)]
    assert np.allclose(column(df, A.paa_uneven(F.col("values"), 16, 50)), np.stack(parts, axis=1))


def test_dft_agrees_with_fft_and_parseval(series):
    df, x = series
    ks = list(range(26))
    c = column(df, A.dft(F.col("values"), 50, ks))
    assert np.allclose(c, coefficients_of(x, ks), atol=1e-9)
    w = np.array(D.sfa_weights(50, ks))
    assert np.allclose((c**2 * w).sum(axis=1), (x**2).sum(axis=1))
    assert np.allclose(column(df, A.inverse_dft(A.dft(F.col("values"), 50, ks), 50, ks)), x, atol=1e-8)


@pytest.mark.parametrize("bits", [2, 8])
def test_bounds_never_exceed_distances(series, bits):
    df, x = series
    zd = df.select("series_id", A.znorm(F.col("values")).alias("values"))
    a = zd.withColumn("word", A.sax_word(A.paa(F.col("values"), 16, 50), 1 << bits))
    q = zd.select(F.col("series_id").alias("q_id"), F.col("values").alias("q"), A.paa(F.col("values"), 16, 50).alias("p"))
    both = a.crossJoin(q).select(D.l2sq(F.col("values"), F.col("q")).alias("d"), D.lb_sax(F.col("p"), F.col("word"), 1 << bits, 3).alias("lb"))
    assert both.where("lb > d + 1e-9").count() == 0


def test_envelope_and_keogh_bound_dtw(series):
    df, x = series
    env = [r[0] for r in df.orderBy("series_id").select(A.envelope(F.col("values"), 3)).collect()]
    lo = np.array([[e["lo"] for e in r] for r in env])
    assert np.allclose(lo, [[r[max(0, i - 3) : i + 4].min() for i in range(50)] for r in x])
    assert np.allclose(dtw_block(x[:5], x[5:10], 0), ((x[:5] - x[5:10]) ** 2).sum(axis=1))
    wide = [dtw_block(x[:20], x[20:40], r) for r in (0, 1, 3, 10)]
    assert all((b <= a + 1e-9).all() for a, b in zip(wide, wide[1:], strict=False))


def test_breakpoints_and_symbols(spark):
    assert A.breakpoints(4)[1] == 0
    row = spark.range(1).select(A.sax_word(F.array(F.lit(-9.0), F.lit(0.0), F.lit(9.0)), 4).alias("l"), A.sax_word(F.array(F.lit(-9.0), F.lit(0.0), F.lit(9.0)), 4, "right").alias("r")).first()
    assert row["l"] == [0, 1, 3] and row["r"] == [0, 2, 3]


def test_split_loses_no_word():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 256, size=(500, 8)), axis=0)
    counts = rng.integers(1, 50, size=len(words))
    for rule in ("variance", "informed", "round-robin"):
        leaves = split_words(words, counts, 8, 100, rule)
        assert sorted(np.concatenate([r for r, _, _ in leaves])) == list(range(len(words)))
        assert all(counts[r].sum() <= 100 or len(r) == 1 for r, _, _ in leaves)
    same = np.repeat(words[:1], 3, axis=0)
    assert choose_segment(same, np.ones(3, dtype=int), np.ones(8, dtype=int), 8, "variance", 0) is None


def test_small_functions(spark):
    df = spark.createDataFrame([([1.0, -1.0, float("nan"), None],)], "v array<double>")
    assert df.select(A.nan_to_zero(F.col("v"))).first()[0] == [1.0, -1.0, 0.0, 0.0]
    one = spark.createDataFrame([([5.0],), ([1.0, -1.0, 1.0, 1.0],)], "v array<double>")
    assert sorted(r[0] for r in one.select(A.zero_crossings(F.col("v"))).collect()) == [0.0, 0.5]
    assert one.select(F.size(A.windows(F.col("v"), 2))).collect()[0][0] == 0


def test_configuration_is_checked():
    for bad in ({"w": 0}, {"w": 65}, {"bits": 9}, {"candidates": 2}):
        with pytest.raises(ValueError):
            SeriesConfig(n=64, **bad)
    assert math.isclose(SeriesConfig(n=50).segment, 3)
