"""The series functions by name, for SQL.

``register`` makes temporary functions of the session for one configuration. All but ``dtw``
and ``sfa_word`` are SQL expressions that Catalyst puts into the calling plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import SeriesConfig
from .arrays import breakpoints
from .kernels import coefficients_of, dtw_block

_V = "ARRAY<DOUBLE>"


def register(spark: SparkSession, config: SeriesConfig, model=None, *, band: int = 5) -> list[str]:
    """l2sq(a, b), znorm(v), paa(v), sax_word(v), dtw(a, b) and, with a learned ``model``, sfa_word(v). Returns their names.

    ``paa`` and the words take series of the configured length; ``sax_word`` and ``sfa_word`` do not normalise.
    """
    w, m, n = config.w, config.segment, config.n
    edges = ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in breakpoints(config.alphabet))
    mean = "(aggregate(v, 0D, (s, x) -> s + x) / size(v))"
    texts = {
        "l2sq": (f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
        "znorm": (f"v {_V}", _V, f"transform(array(named_struct('mean', {mean})), p -> transform(array(sqrt(aggregate(v, 0D, (s, x) -> s + (x - p.mean) * (x - p.mean)) / size(v))), sd -> transform(v, x -> (x - p.mean) / IF(sd < 1e-8, 1D, sd)))[0])[0]"),
        "paa": (f"v {_V}", _V, f"transform(sequence(0, {w - 1}), i -> aggregate(slice(v, i * {m} + 1, {m}), 0D, (s, x) -> s + x) / {m})"),
        "sax_word": (f"v {_V}", "ARRAY<SMALLINT>", f"transform(sequence(0, {w - 1}), i -> CAST(size(filter(array({edges}), e -> e < aggregate(slice(v, i * {m} + 1, {m}), 0D, (s, x) -> s + x) / {m})) AS SMALLINT))"),
    }
    for name, (arguments, result, body) in texts.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    def each(values: pd.Series, length: int) -> np.ndarray:
        return np.array([v is not None and len(v) == length for v in values], dtype=bool)

    @F.pandas_udf("double")
    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = each(a, n) & each(b, n)
        out = np.full(len(a), np.nan)
        if ok.any():
            out[ok] = dtw_block(np.stack(a[ok].to_numpy()).astype(float), np.stack(b[ok].to_numpy()).astype(float), band)
        return pd.Series(out).where(ok, None)

    spark.udf.register("dtw", dtw)
    names = [*texts, "dtw"]
    if model is not None:

        @F.pandas_udf("array<smallint>")
        def sfa_word(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in parts:
                ok = each(v, n)
                out = np.full(len(v), None, dtype=object)
                if ok.any():
                    c = np.round(coefficients_of(np.stack(v[ok].to_numpy()).astype(float), list(model.coefficients)), 6)
                    word = np.stack([np.searchsorted(b, c[:, i], side="right") for i, b in enumerate(model.bins)], axis=1).astype(np.int16)
                    for i, row in zip(np.flatnonzero(ok), word, strict=True):
                        out[i] = row
                yield pd.Series(out)

        spark.udf.register("sfa_word", sfa_word)
        names.append("sfa_word")
    return names
