"""Learning a Fourier summary: sampling, variances of coefficients, bins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..functions.kernels import coefficients_of, matrix_of
from ..sources.matrix import shared_folder

#: Cells of about as many different values each in which a group's values are ranked apart, and the accuracy of their borders.
CELLS, BORDER_ACCURACY = 4096, 40_000
#: Groups whose borders are broadcast, at most.
BROADCAST_GROUPS = 1000


@dataclass(frozen=True)
class SfaModel:
    """Chosen coefficients k, and 2^bits - 1 bins for each of the 2 * len(coefficients) values."""

    coefficients: list[int]
    bins: list[list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> SfaModel:
        return SfaModel(**json.loads(text))


def hash_fraction(series_id: Column) -> Column:
    """A fixed number in [0, 1) for each id, the same in any SQL engine."""
    return F.pmod(series_id.cast("long") % F.lit(4294967296) * F.lit(2654435761 % 2147483647), F.lit(4294967296)) / 4294967296.0


def sample(series: DataFrame, count: int, kind: str) -> DataFrame:
    """'first': ids below count; 'stride': every (rows / count)-th id; 'hash': about count rows by a hash of the id."""
    if kind == "first":
        return series.where(F.col("series_id") < count)
    rows = series.count()
    if kind == "stride":
        return series.where(F.col("series_id") % max(1, rows // max(1, count)) == 0)
    return series if rows <= count else series.where(hash_fraction(F.col("series_id")) < count / rows)


def coefficient_values(series: DataFrame, n: int, candidates: list[int]) -> DataFrame:
    """(series_id, k, re, im), rounded to 6 decimals so that bins and symbols agree everywhere. Rows of other lengths than n are left out."""
    ks = np.array(candidates, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.round(coefficients_of(matrix_of(batch.column("values")), candidates), 6)
            ids = np.repeat(batch.column("series_id").to_numpy(), len(ks))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.tile(ks, len(c))), pa.array(c[:, 0::2].ravel()), pa.array(c[:, 1::2].ravel())], ["series_id", "k", "re", "im"])

    rows = series.where(F.size("values") == n).select(F.col("series_id").cast("long"), "values")
    return rows.mapInArrow(run, "series_id long, k int, re double, im double")


def coefficient_variance(values: DataFrame) -> DataFrame:
    """(k, variance): var_pop of the real plus that of the imaginary parts."""
    return values.groupBy("k").agg((F.var_pop("re") + F.var_pop("im")).alias("variance"))


def choose_coefficients(variance: DataFrame, count: int) -> list[int]:
    """The ``count`` most variable coefficients, ascending."""
    return sorted(r["k"] for r in variance.orderBy(F.desc(F.round("variance", 9)), "k").limit(count).collect())


def positions(values: DataFrame, coefficients: list[int]) -> DataFrame:
    """(seg, x): the values by their place in the summary."""
    place = F.create_map(*[x for i, k in enumerate(coefficients) for x in (F.lit(k), F.lit(i))])
    chosen = values.where(F.col("k").isin(coefficients)).withColumn("i", place[F.col("k")])
    return chosen.select(F.explode(F.array(F.struct((F.col("i") * 2).alias("seg"), F.col("re").alias("x")), F.struct((F.col("i") * 2 + 1).alias("seg"), F.col("im").alias("x")))).alias("p")).select("p.*")


def cells(values: DataFrame) -> DataFrame:
    """(seg, x, n, s, cell): the different values of each seg with their counts, the seg's count, and cells that part them in order.

    Cell borders are approximate quantiles of the different values, so a cell has about an equal number of
    them wherever they lie: neither far values nor frequent ones make a large cell. Approximate quantiles
    depend on the order in which a shuffle brings the rows, and callers join the cells with sums over
    them, so the borders are found once, written and read back.
    """
    spark, path = values.sparkSession, f"{shared_folder(values.sparkSession)}/borders-{uuid.uuid4().hex}"
    counted = values.groupBy("seg", "x").agg(F.count("*").alias("n"))
    cuts = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    borders = counted.groupBy("seg").agg(F.percentile_approx("x", cuts, BORDER_ACCURACY).alias("borders"), F.sum("n").alias("s"))
    borders.write.parquet(path)
    borders = spark.read.schema(borders.schema).parquet(path)
    kinds = dict(values.dtypes)
    if kinds["x"] == "double" and kinds["seg"] in ("int", "bigint", "string") and borders.select("seg").limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return _cells_of(counted, borders)
    borders = F.broadcast(borders) if borders.select("seg").limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else borders
    # the number of borders not above x, by bisection
    start = F.struct(F.lit(0).alias("lo"), F.size("borders").alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["lo"] < at["hi"]) & (F.get("borders", F.least(mid, F.size("borders") - 1)) <= F.col("x"))
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when((at["lo"] < at["hi"]) & ~right, mid).otherwise(at["hi"]).alias("hi"))

    cell = F.aggregate(F.sequence(F.lit(0), F.lit(CELLS.bit_length())), start, halve)["lo"]
    return counted.join(borders, "seg").select("seg", "x", "n", "s", cell.alias("cell"))


def _cells_of(counted: DataFrame, borders: DataFrame) -> DataFrame:
    """``cells`` of doubles with the borders of few groups in every task, so that no row carries its group's borders."""
    got = borders.toArrow()
    edges = {seg: (np.array(b or []), s) for seg, b, s in zip(*(got[c].to_pylist() for c in ("seg", "borders", "s")), strict=True)}
    held = counted.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, x = batch.column("seg").dictionary_encode(), batch.column("x").to_numpy(zero_copy_only=False)
            place, cell, total = seg.indices.to_numpy(), np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
            for i, name in enumerate(seg.dictionary.to_pylist()):
                at = place == i
                # the number of borders not above x
                cell[at], total[at] = np.searchsorted(held.value[name][0], x[at], side="right"), held.value[name][1]
            # nulls come first
            cell[batch.column("x").is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("seg", "x", "n")), pa.array(total), pa.array(cell)], ["seg", "x", "n", "s", "cell"])

    kind = counted.schema["seg"].dataType.simpleString()
    return counted.where("seg is not null").select("seg", "x", "n").mapInArrow(run, f"seg {kind}, x double, n long, s long, cell int")


def ranks(values: DataFrame) -> DataFrame:
    """(seg, x, n, s, first): value x has the ranks first .. first + n - 1, from 0, among the s values of its seg.

    Ranks are exact and need no task to sort a whole seg: cells are summed up one after another, and
    only a cell's different values are sorted together.
    """
    counted = cells(values)
    # at most CELLS rows a seg
    before = Window.partitionBy("seg").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.groupBy("seg", "cell").agg(F.sum("n").alias("n")).select("seg", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("seg", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, ["seg", "cell"])
    return ranked.select("seg", "x", "n", "s", (F.col("base") + F.col("before")).alias("first"))


def equi_depth(values: DataFrame, alphabet: int) -> DataFrame:
    """(seg, bin, edge): of S sorted values the one at floor((bin + 1) * S / alphabet), bin = 0 .. alphabet - 2."""
    # edge b is at rank floor(b * s / alphabet)
    up = lambda rank: F.expr(f"({rank} * {alphabet} + s - 1) div s")
    lo, hi = F.greatest(up("first"), F.lit(1)), F.least(up("(first + n)") - 1, F.lit(alphabet - 1))
    held = ranks(values).select("seg", "x", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return held.select("seg", F.explode(F.sequence("lo", "hi")).alias("b"), "x").select("seg", (F.col("b") - 1).cast("int").alias("bin"), F.col("x").alias("edge"))


def percentiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(seg, one column for each of ``shares``): exact percentiles of (seg, x), between neighbours by linear interpolation. Nulls take no part."""
    ranked = ranks(values.where("x is not null"))
    out = []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("s") - 1)
        at = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("first") + F.col("n")), F.col("x")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy("seg").agg(*out)


def equi_width(values: DataFrame, alphabet: int) -> DataFrame:
    """(seg, bin, edge): min + (bin + 1) * (max - min) / alphabet."""
    ends = values.groupBy("seg").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return ends.select("seg", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(alphabet - 2))).alias("bin")).select("seg", "bin", (F.col("a") + (F.col("bin") + 1) * (F.col("b") - F.col("a")) / alphabet).alias("edge"))


def learn(series: DataFrame, config: SeriesConfig) -> SfaModel:
    """Learn the bins of (series_id, values) as prepared for the index; the sample's size is bounded by the configuration."""
    chosen = sample(series, *config.sample)
    first = 1 if config.skip_dc else 0
    half = config.w // 2
    candidates = list(range(first, first + (config.candidates // 2 if config.candidates else half)))
    candidates = [k for k in candidates if k <= config.n // 2]
    values = coefficient_values(chosen, config.n, candidates).persist()
    try:
        kept = choose_coefficients(coefficient_variance(values), half) if config.candidates else candidates
        placed = positions(values, kept)
        edges = (equi_depth if config.binning == "equi-depth" else equi_width)(placed, config.alphabet)
        bins: list[list[float]] = [[] for _ in range(2 * len(kept))]
        for r in edges.orderBy("seg", "bin").collect():
            bins[r["seg"]].append(r["edge"])
    finally:
        values.unpersist()
    return SfaModel(kept, bins)
