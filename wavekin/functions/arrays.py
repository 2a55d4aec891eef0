"""Per-series operators as native Column expressions over ARRAY<DOUBLE>.

Nothing here runs Python on the executors. Positions and segments count from 0.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def stddev(v: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.aggregate(F.transform(v, lambda x: F.pow(x - mean(v), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / F.size(v))


def moments(v: Column) -> Column:
    """struct(mean, sd) in two passes over the array."""
    return F.transform(F.array(mean(v)), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)).alias("sd")))[0]


def znorm(v: Column, variant: str = "standard") -> Column:
    """z-normalised values.

    standard: sd below 1e-8 counts as 1; centre: with sd up to 1e-4 only the mean is
    removed; epsilon: divided by sd + 1e-8; flipped: (mean - x) / sd; zero: as standard,
    but constant series become 0.
    """
    def scaled(m):
        mu, sd = m["mean"], m["sd"]
        if variant == "centre":
            return F.transform(v, lambda x: F.when(sd <= 1e-4, x - mu).otherwise((x - mu) / sd))
        if variant == "epsilon":
            return F.transform(v, lambda x: (x - mu) / (sd + 1e-8))
        safe = F.when(sd < 1e-8, F.lit(1.0)).otherwise(sd)
        if variant == "flipped":
            return F.transform(v, lambda x: (mu - x) / safe)
        if variant == "zero":
            return F.transform(v, lambda x: F.when(sd < 1e-8, F.lit(0.0)).otherwise((x - mu) / safe))
        return F.transform(v, lambda x: (x - mu) / safe)

    return F.transform(F.array(moments(v)), scaled)[0]


def paa(v: Column, w: int, n: int) -> Column:
    """Means of n // w consecutive values; the last n - w * (n // w) are left out."""
    m = n // w
    return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.aggregate(F.slice(v, i * m + 1, F.lit(m)), F.lit(0.0), lambda a, x: a + x) / F.lit(float(m)))


def uneven_bounds(n: int, w: int) -> list[tuple[int, int]]:
    """(start, length) of w parts of n values, the first n % w one longer."""
    out, at = [], 0
    for i in range(w):
        size = n // w + (i < n % w)
        out.append((at, size))
        at += size
    return out


def paa_uneven(v: Column, w: int, n: int) -> Column:
    return F.array(*[F.aggregate(F.slice(v, a + 1, c), F.lit(0.0), lambda s, x: s + x) / F.lit(float(c)) for a, c in uneven_bounds(n, w)])


def paa_expand(p: Column, w: int, n: int) -> Column:
    """Every mean repeated for its part's values."""
    return F.flatten(F.array(*[F.array_repeat(p[i], c) for i, (_, c) in enumerate(uneven_bounds(n, w))]))


def breakpoints(alphabet: int) -> list[float]:
    """Standard normal quantiles i / alphabet, i = 1 .. alphabet - 1."""
    normal = NormalDist()
    return [normal.inv_cdf(i / alphabet) for i in range(1, alphabet)]


def symbol(x: Column, bins: Column, side: str = "left") -> Column:
    """Bins strictly below x ('left'), or bins up to and including x ('right')."""
    return F.size(F.filter(bins, (lambda b: b < x) if side == "left" else (lambda b: b <= x))).cast("smallint")


def sax_word(p: Column, alphabet: int, side: str = "left") -> Column:
    bins = literal_array(breakpoints(alphabet))
    return F.transform(p, lambda x: symbol(x, bins, side))


def dft(v: Column, n: int, coefficients: list[int]) -> Column:
    """Real and negated imaginary parts of X_k / sqrt(n), interleaved, for the given k. The imaginary part of k = 0 is 0."""
    parts = []
    for k in coefficients:
        c = literal_array(math.cos(2 * math.pi * k * j / n) / math.sqrt(n) for j in range(n))
        parts.append(F.aggregate(F.zip_with(v, c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
        if k == 0:
            parts.append(F.lit(0.0))
        else:
            s = literal_array(math.sin(2 * math.pi * k * j / n) / math.sqrt(n) for j in range(n))
            parts.append(F.aggregate(F.zip_with(v, s, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    return F.array(*parts)


def inverse_dft(c: Column, n: int, coefficients: list[int]) -> Column:
    """The series that has only the given coefficients, in the layout of ``dft``."""
    def at(j):
        terms = []
        for i, k in enumerate(coefficients):
            share = 1.0 if k == 0 or 2 * k == n else 2.0
            angle = F.lit(2 * math.pi * k / n) * j
            terms.append((c[2 * i] * F.cos(angle) + c[2 * i + 1] * F.sin(angle)) * F.lit(share / math.sqrt(n)))
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: at(j.cast("double")))


def sfa_word(c: Column, bins: list[list[float]]) -> Column:
    """Symbols of the coefficients: how many of a position's bins are <= its value."""
    table = F.array(*[literal_array(b) for b in bins])
    return F.transform(c, lambda x, i: symbol(x, table[i], "right"))


def sfa_ends(word: Column, bins: list[list[float]]) -> Column:
    """array of (lo, hi): the edges of each symbol's bin; the outermost bins end at the outermost edges."""
    table = F.array(*[literal_array(b) for b in bins])
    last = F.lit(len(bins[0]) - 1)

    def ends(s, i):
        edges, at = table[i], s.cast("int")
        return F.struct(edges[F.greatest(at - 1, F.lit(0))].alias("lo"), edges[F.least(at, last)].alias("hi"))

    return F.transform(word, ends)


def root_key(word: Column, bits: int) -> Column:
    """The top bits of all symbols as one number, segment 0 most significant."""
    return F.aggregate(word, F.lit(0).cast("long"), lambda a, s: a * 2 + F.shiftright(s.cast("int"), bits - 1).cast("long"))


def leaf_label(word: Column, cardinality: Column, bits: int) -> Column:
    """'prefix.bits' of every segment, joined by '_'."""
    return F.array_join(F.zip_with(word, cardinality, lambda s, c: F.concat(F.call_function("shiftright", s.cast("int"), F.lit(bits) - c.cast("int")).cast("string"), F.lit("."), c.cast("string"))), "_")


def region(word: Column, cardinality: Column, bits: int) -> Column:
    """array of (lo, hi): the symbols that share each segment's first bits."""
    def one(s, c):
        shift = F.lit(bits) - c.cast("int")
        lo = F.call_function("shiftleft", F.call_function("shiftright", s.cast("int"), shift), shift)
        return F.struct(lo.alias("lo"), (lo + F.call_function("shiftleft", F.lit(1), shift) - 1).alias("hi"))

    return F.zip_with(word, cardinality, one)


def packed_bits(word: Column, bits: int) -> Column:
    return F.array_join(F.transform(word, lambda s: F.lpad(F.bin(s.cast("long")), bits, "0")), "")


def packed_hex(word: Column) -> Column:
    return F.array_join(F.transform(word, lambda s: F.lpad(F.lower(F.hex(s.cast("long"))), 2, "0")), "")


def envelope(v: Column, r: int) -> Column:
    """array of (lo, hi): smallest and largest value at most r positions away."""
    def one(i):
        start = F.greatest(i - r, F.lit(0))
        part = F.slice(v, start + 1, F.least(i + r, F.size(v) - 1) - start + 1)
        return F.struct(F.array_min(part).alias("lo"), F.array_max(part).alias("hi"))

    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), one)


def zero_crossings(v: Column) -> Column:
    """Sign changes per value; 0 for fewer than two values."""
    changes = F.size(F.filter(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.signum(a) != F.signum(b)), lambda x: x))
    return F.when(F.size(v) > 1, changes / F.size(v)).otherwise(F.lit(0.0))


def nan_to_zero(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))


def windows(v: Column, n: int) -> Column:
    """Non-overlapping windows of n values; an incomplete last one is left out."""
    count = F.floor(F.size(v) / n).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.slice(v, i * n + 1, F.lit(n)))


def event_window(v: Column, at: Column, before: int, after: int) -> Column:
    """``before`` values before position ``at`` and ``after`` from it on, clamped at the ends."""
    start = F.greatest(at - before, F.lit(0))
    return F.slice(v, start + 1, F.least(at + after, F.size(v)) - start)


def add_noise(v: Column, level: float, seed: int) -> Column:
    """Values plus level * sd * pseudo-normal noise from a hash of (seed, position, value), rounded up."""
    unit = lambda x, i, salt: (F.pmod(F.xxhash64(x, i, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    sd = moments(v)["sd"]
    noise = lambda x, i: F.sqrt(-2 * F.log(unit(x, i, 1))) * F.cos(2 * math.pi * unit(x, i, 2))
    return F.transform(v, lambda x, i: F.ceil(x + F.lit(level) * sd * noise(x, i)).cast("double"))


def random_walk(series_id: Column, n: int, seed: int) -> Column:
    """A walk of n steps of -1 .. 1 that depends on the id and the seed only."""
    step = lambda i: F.pmod(F.xxhash64(series_id, i, F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<double>"), lambda a, i: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + step(i))))
    return walk
