"""Mixing sources to target weights by entropy balancing.

A document's rate, the copies it should get, is min(cap, exp(lambda_s * size / mean_s)) for its
source s: of all rates up to the cap whose words sum to the source's target, the ones
nearest to 1 for every document in relative entropy. The multipliers lambda solve the
convex dual, whose gradient is each source's words less its target. All sources are
solved at once by Newton steps kept in a bracket. One step is an aggregation over a
table of (source, size, count), which is far smaller than the documents.

Rates become whole copies by carrying the rounding error, in words, from longer to
shorter documents, so a source's words miss the target by less than its shortest
documents' size, where fractions allow it.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_or_empty

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

#: Sums are exact decimals, so they and all that follows are the same in every run.
EXACT = "decimal(38,9)"
PARTS, PART_ROWS = 256, 1_000_000
#: Sources whose facts are broadcast, at most; more are joined by a shuffle.
BROADCAST_SOURCES = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.0, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source: weights repeat over the sources by code point, null last; none above cap times its size."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), order
    while open_:
        total = sum(weight[s] for s in open_)
        trial = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if trial[s] > cap * sizes[s]]
        if not over:
            return out | trial
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of known size, to be broadcast up to BROADCAST_SOURCES rows."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _held(spark: SparkSession, schema: str, **columns: pa.Array) -> DataFrame:
    """A table of the driver's own columns; sent as Arrow, so that no executor starts Python for it."""
    return spark.createDataFrame(pa.table(columns), schema) if len(next(iter(columns.values()))) else spark.createDataFrame([], schema)


_LAM = "sid int, lam double, mean double"


def _lam_columns(rows: list[tuple[int, float, float]]) -> dict[str, pa.Array]:
    kinds = {"sid": pa.int32(), "lam": pa.float64(), "mean": pa.float64()}
    return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}


def _solve(hist: DataFrame, facts: pd.DataFrame, cap: float, tolerance: float, most: int) -> dict[int, float]:
    """lambda of each source number in ``facts`` (sid, total, target, mean)."""
    spark = hist.sparkSession
    state = {}
    for r in facts.itertuples():
        if r.total <= 0 or r.target >= cap * r.total * (1 - 1e-12):
            state[r.sid] = (math.inf, 0.0, 0.0, True)
        elif r.target <= 0:
            state[r.sid] = (-math.inf, 0.0, 0.0, True)
        else:
            state[r.sid] = (math.log(min(cap, r.target / r.total)), -math.inf, math.inf, False)
    target = {r.sid: r.target for r in facts.itertuples()}
    mean = {r.sid: float(r.mean) for r in facts.itertuples()}
    for _ in range(most):
        live = [(sid, s[0], mean[sid]) for sid, s in state.items() if not s[3]]
        if not live:
            break
        # one row for each source, as collected for the targets
        now = _small(_held(spark, _LAM, **_lam_columns(live)), len(live))
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(50.0))))
        words = F.col("n") * F.col("size")
        got = hist.join(now, "sid").groupBy("sid").agg(F.sum((words * rate).cast(EXACT)).alias("g"), F.sum(F.when(rate < cap, words * rate * F.col("size") / F.col("mean")).otherwise(0.0).cast(EXACT)).alias("h")).collect()
        for r in got:
            lam, low, high, _ = state[r["sid"]]
            gap, slope = float(r["g"]) - target[r["sid"]], float(r["h"])
            if abs(gap) <= tolerance * target[r["sid"]]:
                state[r["sid"]] = (lam, low, high, True)
                continue
            low, high = (low, lam) if gap > 0 else (lam, high)
            step = lam - gap / slope if slope > 0 else math.nan
            if not low < step < high:
                if math.isinf(low) or math.isinf(high):
                    step = lam - math.copysign(max(1.0, abs(lam)), gap)
                else:
                    step = (low + high) / 2
            state[r["sid"]] = (step, low, high, step in (low, high))
    return {sid: s[0] for sid, s in state.items()}


def _copies(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Whole copies for the n documents of each size of one source.

    First between the rate's floor and ceiling; what then is left of the error goes to
    any sizes that still fit into it, longest first, within 0 to ``cap`` copies each.
    """
    pdf = pdf.sort_values("size", ascending=False)
    sizes, counts, carry, whole = pdf["size"].tolist(), pdf["n"].tolist(), 0.0, []
    for size, n, rate in zip(sizes, counts, pdf["rate"], strict=True):
        low, high = n * math.floor(rate), n * math.ceil(rate)
        whole.append(min(high, max(low, math.floor(n * rate + carry / size + 0.5))))
        carry += (n * rate - whole[-1]) * size
    for i, (size, n) in enumerate(zip(sizes, counts, strict=True)):
        more = min(cap * n, max(0, whole[i] + math.floor(carry / size + 0.5))) - whole[i]
        whole[i] += more
        carry -= more * size
    return pd.DataFrame({"sid": pdf["sid"], "size": sizes, "base": [k // n for k, n in zip(whole, counts, strict=True)], "extra": [k % n for k, n in zip(whole, counts, strict=True)]})


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.0, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tolerance: float = 1e-10, most: int = 60) -> DataFrame:
    """Copies of every document such that each source's words come near its target.

    Returns (doc_id, size, source_size, target, copies, taken): taken = copies * size, 0 to ``cap`` copies. A null
    text has size 0. Documents of size 0 count for no target and keep one copy, in
    sources of target 0 as well. A null source is a source of its own, the last. Rows
    that repeat a doc_id are documents of their own; which of equally long ones gets a
    copy more is decided by a hash of the id. Reruns agree. Other columns of the input
    are ignored. An empty table gives no rows.

    The driver holds one row for each source.
    """
    spark = docs.sparkSession
    size = word_count(text_or_empty(text_col))
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    totals = {r["source"]: r["total"] for r in rows.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    goal = targets(totals, weights, share, cap)
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    counts = {r["source"]: r["n"] for r in rows.where("size > 0").groupBy("source").agg(F.count("*").alias("n")).collect()}
    facts = pd.DataFrame([(i, s, int(totals[s]), float(goal[s]), totals[s] / max(1, counts.get(s, 0))) for i, s in enumerate(order)], columns=["sid", "source", "total", "target", "mean"])
    named = _held(spark, "sid int, source string, total long, target double", sid=pa.array(range(len(order)), pa.int32()), source=pa.array(order, pa.string()), total=pa.array([int(totals[s]) for s in order], pa.int64()), target=pa.array([float(goal[s]) for s in order], pa.float64()))

    # a common size of one source is numbered in parts, so no task sorts more than about PART_ROWS rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(max(PARTS, -(-rows.count() // PART_ROWS)))).cast("int")
    numbered = rows.join(_small(named.select("sid", "source", F.col("total").alias("source_size"), "target"), len(facts)), rows["source"].eqNullSafe(named["source"])).select("doc_id", "sid", "size", "source_size", "target", part.alias("part"))
    cells = stage(numbered.where("size > 0").groupBy("sid", "size", "part").agg(F.count("*").alias("n")), "cells")
    hist = stage(cells.groupBy("sid", "size").agg(F.sum("n").alias("n")), "sizes-of-sources")
    lam = _solve(hist, facts, cap, tolerance, most)
    solved = _small(_held(spark, _LAM, **_lam_columns([(int(r.sid), float(lam[r.sid]), float(r.mean)) for r in facts.itertuples()])), len(facts))
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(50.0))))
    # one group holds a source's different sizes, not its documents
    whole = hist.join(solved, "sid").select("sid", "size", "n", rate.alias("rate")).groupBy("sid").applyInPandas(lambda pdf: _copies(pdf, cap), "sid int, size long, base long, extra long")

    before = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(whole, ["sid", "size"])
    within = Window.partitionBy("sid", "size", "part").orderBy(F.xxhash64("doc_id", F.lit("nth")), "doc_id")
    ranked = numbered.withColumn("nth", F.row_number().over(within))
    out = ranked.join(placed.select("sid", "size", "part", "before", "base", "extra"), ["sid", "size", "part"], "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + (F.col("before") + F.col("nth") <= F.col("extra")).cast("long"))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
