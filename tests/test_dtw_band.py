"""A block of banded DTW holds the cells of its band, and blocks are large enough for numpy's calls to be few."""

import tracemalloc

import numpy as np
import pytest

from wavekin.config import SeriesConfig
from wavekin.functions import kernels as K
from wavekin.operators import search as S


def plain(a, b, r):
    n = len(a)
    c = np.full((n + 1, n + 1), np.inf)
    c[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - r), min(n, i + r) + 1):
            c[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[n, n]


@pytest.mark.parametrize("n, r", [(1, 0), (1, 2), (2, 1), (9, 0), (9, 1), (9, 2), (9, 20), (16, 3)])
def test_equal_to_the_plain_recursion(n, r):
    rng = np.random.default_rng(n + r)
    x, y = rng.normal(size=(7, n)), rng.normal(size=(7, n))
    want = [plain(a, b, r) for a, b in zip(x, y, strict=True)]
    assert np.allclose(K.dtw_block(x, y, r), want)
    limit = float(np.median(want))
    some = K.dtw_limited(x, y, r, limit)[0]
    assert np.allclose(some[np.array(want) <= limit], [w for w in want if w <= limit]) and np.isinf(some[np.array(want) > limit]).all()


def test_a_block_holds_its_band_only():
    x = np.random.default_rng(1).normal(size=(2000, 256))
    tracemalloc.start()
    try:
        K.dtw_block(x, x[:1], 2)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * x.nbytes
    finally:
        tracemalloc.stop()


def test_the_nearest_row_is_found_over_several_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    c = SeriesConfig(n=16, w=4, z_normalize=False)
    monkeypatch.setattr(S, "DTW_PAIRS", 64)
    m = S.BandedDtw(S.QuerySet(np.arange(3), x[:3] + 0.1), K.WordBounds(c), c.w, c.segment, 2)
    for j in range(3):
        full = K.dtw_block(x, x[j : j + 1] + 0.1, 2)
        got = m.distances(j, x, float(full.min()) * 2)
        assert got.argmin() == full.argmin() and got.min() == full.min()
