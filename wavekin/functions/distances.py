"""Distances and lower bounds as native Column expressions. All distances are squared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import breakpoints, literal_array


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot_form(a: Column, b: Column) -> Column:
    """2n(1 - <a, b> / n), the squared distance of z-normalised series."""
    n = F.size(a)
    return 2 * n * (1 - _sum(F.zip_with(a, b, lambda x, y: x * y)) / n)


def lb_keogh(candidate: Column, envelope: Column) -> Column:
    """Squared distance from the candidate to the query's envelope (array of (lo, hi))."""
    return _sum(F.zip_with(candidate, envelope, lambda x, e: F.when(x > e["hi"], (x - e["hi"]) * (x - e["hi"])).when(x < e["lo"], (x - e["lo"]) * (x - e["lo"])).otherwise(0.0)))


def _edges(alphabet: int) -> Column:
    """Lower edge of symbol s at s, upper edge at s + 1."""
    return literal_array([float("-inf"), *breakpoints(alphabet), float("inf")])


def _gap(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value < lo, (lo - value) * (lo - value)).when(value > hi, (value - hi) * (value - hi)).otherwise(0.0)


def lb_sax(p: Column, word: Column, alphabet: int, scale: int) -> Column:
    """Squared distance of a PAA vector to a word's regions times the segment length."""
    edges = _edges(alphabet)
    return F.lit(float(scale)) * _sum(F.zip_with(p, word, lambda x, s: _gap(x, edges[s.cast("int")], edges[s.cast("int") + 1])))


def lb_sax_region(p: Column, lo: Column, hi: Column, alphabet: int, scale: int) -> Column:
    """The same for symbol ranges lo .. hi (arrays)."""
    edges = _edges(alphabet)
    gaps = F.zip_with(p, F.arrays_zip(lo.alias("l"), hi.alias("h")), lambda x, r: _gap(x, edges[r["l"].cast("int")], edges[r["h"].cast("int") + 1]))
    return F.lit(float(scale)) * _sum(gaps)


def lb_sax_dtw(lower: Column, upper: Column, word: Column, alphabet: int, scale: int) -> Column:
    """Bound of banded DTW from the PAA of the query's envelope."""
    edges = _edges(alphabet)
    def gap(e, s):
        lo, hi = edges[s.cast("int")], edges[s.cast("int") + 1]
        return F.when(lo > e["u"], (lo - e["u"]) * (lo - e["u"])).when(hi < e["l"], (e["l"] - hi) * (e["l"] - hi)).otherwise(0.0)

    return F.lit(float(scale)) * _sum(F.zip_with(F.arrays_zip(lower.alias("l"), upper.alias("u")), word, gap))


def sfa_weights(n: int, coefficients: list[int]) -> list[float]:
    """Parseval weights of the interleaved coefficients: 1 for the mean and the Nyquist frequency, else 2."""
    return [1.0 if k == 0 or 2 * k == n else 2.0 for k in coefficients for _ in range(2)]


def lb_sfa(c: Column, word: Column, bins: list[list[float]], weights: list[float], slack: float = 1e-6) -> Column:
    """Weighted squared distance of coefficients to a word's bins.

    Bins and symbols come from values rounded to 6 decimals, so a gap is shortened by ``slack``.
    """
    table = F.array(*[literal_array([float("-inf"), *b, float("inf")]) for b in bins])
    w = literal_array(weights)
    def gap(x, s, i):
        lo, hi = table[i][s], table[i][s + 1]
        d = F.greatest(F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(0.0) - slack, F.lit(0.0))
        return w[i] * d * d

    return _sum(F.transform(F.arrays_zip(c.alias("c"), word.alias("s")), lambda r, i: gap(r["c"], r["s"].cast("int"), i)))


def lb_wedge(v: Column, lower: Column, upper: Column) -> Column:
    """Squared distance of a series to a leaf's pointwise smallest and largest values."""
    return _sum(F.zip_with(v, F.arrays_zip(lower.alias("l"), upper.alias("u")), lambda x, e: _gap(x, e["l"], e["u"])))
