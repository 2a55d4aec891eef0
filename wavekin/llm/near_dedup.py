"""Near-duplicate detection by HyperMinHash sketches.

Every text is reduced to ``REGISTERS`` registers of 16 bits. A shingle's hash picks a
register, which keeps the smallest remaining hash in floating form: the count of its
leading zeros (6 bits) and the bits after the leading one (10-bit mantissa). Registers
that no shingle reached copy one that was reached, chosen by a fixed random walk.

* Documents with equal shingle sets form one class, so exact copies cost one row each.
* Bands of at most ``BAND`` compressed registers, fewer for low thresholds, are candidate
  buckets. A bucket's members are first compared with its smallest member only.
* Candidates pass the collision-corrected Jaccard estimate with a margin of ``MARGIN``
  standard deviations, in which copied registers count, and are then confirmed on their full shingle sets.
* Links join classes to components. Only buckets whose members still lie in different
  components can hide a link that matters. Pairs of their members are compared as well:
  all pairs of a small bucket, and of crowded ones those that an exact prefix and
  position filter leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, passing, release, small_batches, stage, table, tidy
from .components import components
from .shingles import mix, shingle_sets

REGISTERS, BAND, MANTISSA = 192, 6, 10
PERCENT = 85
#: Chance, at most, that a pair at the threshold shares no band, by the banding formula.
MISS = 3e-7
#: Standard deviations of the estimate below the threshold that a candidate may lie.
MARGIN = 6.0
#: Ids of a side that is broadcast, at most: 8 bytes each. Larger sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Members up to which all pairs of a bucket are compared outright.
SMALL_BUCKET = 12

_U = np.uint64
_TRIES = 64
_WALK = (mix(np.arange(REGISTERS * _TRIES, dtype=_U), 11) % _U(REGISTERS)).astype(np.int64).reshape(REGISTERS, _TRIES)
_BAND_KEY = mix(np.arange(REGISTERS, dtype=_U), 12) | _U(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), REGISTERS) uint16 registers. An empty set has all registers 0."""
    low = np.full((len(sets), REGISTERS), 2**64 - 1, dtype=_U)
    for row, s in zip(low, sets, strict=True):
        np.minimum.at(row, ((s >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64), mix(s, 10))
    low = np.minimum(low, _U(2**64 - 2))
    filled = np.zeros(low.shape, bool)
    for row, s in zip(filled, sets, strict=True):
        row[((s >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)] = True
    zeros = np.zeros(low.shape, dtype=_U)
    rest = low.copy()
    for width in (32, 16, 8, 4, 2, 1):
        high = rest < (_U(1) << _U(64 - width))
        zeros[high] += _U(width)
        rest[high] <<= _U(width)
    registers = ((zeros << _U(MANTISSA)) | ((rest << _U(1)) >> _U(64 - MANTISSA))).astype(np.uint16)
    doc, empty = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    source = empty.copy()
    open_ = np.ones(len(doc), bool)
    for t in range(_TRIES):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        to = _WALK[empty[at], t]
        hit = filled[doc[at], to]
        source[at[hit]] = to[hit]
        open_[at[hit]] = False
    for i in np.flatnonzero(open_):  # very small sets: the next register in turn
        have = np.flatnonzero(filled[doc[i]])
        source[i] = have[np.searchsorted(have, empty[i]) % len(have)]
    registers[doc, empty] = registers[doc, source]
    registers[~filled.any(axis=1)] = 0
    return registers


def band_width(percent: int) -> int:
    """Registers of a band: the most, up to BAND, that keep to MISS at the threshold; 1 where none does."""
    return next((b for b in range(BAND, 1, -1) if (1 - (percent / 100) ** b) ** (REGISTERS // b) <= MISS), 1)


def band_keys(registers: np.ndarray, width: int = BAND) -> np.ndarray:
    """(rows, REGISTERS // width) int64 keys of the bands."""
    bands = REGISTERS // width
    part = (mix(registers.astype(_U), 13) * _BAND_KEY)[:, : bands * width].reshape(len(registers), bands, width).sum(axis=2, dtype=_U)
    return mix(part + np.arange(bands, dtype=_U), 14).view(np.int64)


def _collision_table() -> np.ndarray:
    """Chance that registers of disjoint sets agree, by log2 of the shingles a register sees."""
    z, m = np.arange(0, 44)[:, None], np.arange(2**MANTISSA)[None, :]
    low = 2.0 ** -(z + 1) * (1 + m / 2**MANTISSA)
    width = 2.0 ** -(z + 1) / 2**MANTISSA
    out = []
    for log in np.arange(-8, 33):
        c = max(1.0, 2.0**log)
        out.append(float(np.sum((np.exp(-c * low) * -np.expm1(-c * width)) ** 2)) / max(1e-12, -math.expm1(-c)) ** 2)
    return np.array(out)


_COLLIDE = _collision_table()


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from two arrays of registers, corrected for chance agreement."""
    same = (a == b).mean(axis=1)
    seen = np.log2(np.maximum(1, np.sqrt(n_a.astype(float) * n_b)) / REGISTERS)
    chance = _COLLIDE[np.clip(np.rint(seen).astype(int) + 8, 0, len(_COLLIDE) - 1)]
    return np.clip((same - chance) / (1 - chance), 0, 1)


def spread(t: float, n: np.ndarray) -> np.ndarray:
    """Standard deviation of the estimate at similarity t for sets of n shingles.

    About e of the registers are reached by a shingle, the others copy one of them, so
    the e weigh unequally: the squares of their weights add up to 1 / e + (R - e) / R^2.
    """
    reached = REGISTERS * -np.expm1(np.maximum(n, 1) * math.log1p(-1 / REGISTERS))
    return np.sqrt(t * (1 - t) * (1 / reached + (REGISTERS - reached) / REGISTERS**2))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, d1, d2, registers): d1, d2 identify the shingle set, node the document (d1 where its id is null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                sets = list(shingle_sets(part["text"].tolist()))
                regs = sketch(sets)
                d1 = np.array([mix(s, 20).sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)
                d2 = np.array([mix(s, 21).sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)
                ids = part["doc_id"].astype("Int64")
                yield pd.DataFrame({"doc_id": ids, "node": ids.fillna(pd.Series(d1, index=ids.index)).astype("int64"), "n": [len(s) for s in sets], "d1": d1, "d2": d2, "registers": [r.tobytes() for r in regs]})
        release()

    return docs.mapInPandas(run, "doc_id long, node long, n long, d1 long, d2 long, registers binary")


def _bands(reps: DataFrame, width: int) -> DataFrame:
    bands = REGISTERS // width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                keys = band_keys(np.frombuffer(b"".join(part["registers"]), np.uint16).reshape(-1, REGISTERS), width)
                yield pd.DataFrame({"k": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), bands), "n": np.repeat(part["n"].to_numpy(), bands)})
        release()

    return reps.select("node", "n", "registers").mapInPandas(run, "k long, node long, n long")


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): full shingle sets of the named documents, computed again from their texts."""
    n = nodes.count()
    wanted = F.broadcast(nodes) if n <= BROADCAST_IDS else nodes
    named = docs.join(wanted, docs["doc_id"] == nodes["node"], "left_semi").unionByName(docs.where("doc_id is null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                sets = list(shingle_sets(part["text"].tolist()))
                d1 = np.array([mix(s, 20).sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)
                ids = part["doc_id"].astype("Int64")
                yield pd.DataFrame({"node": ids.fillna(pd.Series(d1, index=ids.index)).astype("int64"), "shingles": [s.view(np.int64) for s in sets]})
        release()

    return stage(named.mapInPandas(run, "node long, shingles array<long>"), "sets")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate reaches the threshold less the margin."""
    regs = sketches.select("node", "n", "registers")
    both = pairs.join(regs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a").join(regs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b")
    t = percent / 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n_a, n_b = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
            yield pdf.loc[estimate(a, b, n_a, n_b) >= t - MARGIN * spread(t, np.minimum(n_a, n_b)), ["a", "b"]]
        release()

    return both.mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs confirmed on full sets: (u, v)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("s_a") + F.size("s_b") - both) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the candidate pairs that are linked, staged."""
    likely = stage(_likely(pairs, reps, percent), "likely")
    tidy(docs.sparkSession)
    return stage(_verified(likely, _sets_of(docs, _ends(likely)), percent), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _fits(x: str, y: str, percent: int):
    """Set sizes that a link allows."""
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the component of their node."""
    return rows.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents with 100 * intersection >= percent * union of their 5-word shingle sets.

    Returns (doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable over
    links, kept marks it. A text of fewer than five words is one shingle; a null text or
    one without words has none and is linked with nothing. Rows that share a doc_id
    count as one document with all their texts' links; a null doc_id is a document of
    its own text's, kept only if no id is in its component: its component_id is the
    smallest id there or null. Other columns of the input are ignored. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = stage(_sketches(docs), "sketches")
    full = sk.where("n > 0")
    classes = stage(full.groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.first("n").alias("n")), "classes")
    # a set and one that differs from it share at most n of n + 1 shingles
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62
    reps = stage(full.join(classes.select("d1", "d2", F.col("rep").alias("node")), ["d1", "d2", "node"], "left_semi").where(F.col("n") >= least).select("node", "n", "registers"), "reps")
    bands = _bands(reps, band_width(percent))
    hubs = bands.groupBy("k").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("other")).where("hub.node <> other").select("k", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    buckets = stage(bands.join(hubs, "k").select("k", "node", "n", "hub", "hub_n"), "buckets")

    spark = docs.sparkSession
    pairs = buckets.where("node <> hub").where(_fits("n", "hub_n", percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # rows of one document with different sets hang together as well
    same = full.join(classes, ["d1", "d2"]).where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    with passing(spark) as keep:
        links = _links(pairs, docs, reps, percent)
        first = roots = keep(components(links.unionByName(same)))
    tidy(spark)
    with passing(spark) as keep:
        open_ = stage(_open_pairs(docs, buckets, first, percent), "open")
        more = None if open_.isEmpty() else _links(open_, docs, reps, percent)
        if more is not None and not more.isEmpty():
            roots = keep(components(first.select("u", F.col("root").alias("v")).unionByName(more)))

    tidy(spark)
    of_class = _rooted(classes.select("d1", "d2", F.col("rep").alias("node")), roots).select("d1", "d2", "root")
    named = sk.where("n > 0").join(of_class, ["d1", "d2"]).select("doc_id", "n", "root")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(stage(smallest, "smallest"), "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sk.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_pairs(docs: DataFrame, buckets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket that lie in different components and may still be linked."""
    rows = _rooted(buckets.select("k", "node", "n"), roots)
    mixed = rows.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).where("r0 <> r1").select("k", "members")
    rows = stage(join_counted(rows, mixed, "k", "members", buckets.count()), "mixed")

    def pairs(members: DataFrame) -> DataFrame:
        a, b = (members.select("k", *[F.col(c).alias(f"{c}_{s}") for c in members.columns if c not in ("k", "members")]) for s in "ab")
        on = (a["k"] == b["k"]) & (a["node_a"] < b["node_b"]) & (a["root_a"] != b["root_b"]) & (F.least(a["n_a"], b["n_b"]) * 100 >= F.greatest(a["n_a"], b["n_b"]) * percent)
        return a.join(b, on).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    small = pairs(rows.where(F.col("members") <= SMALL_BUCKET))
    large = stage(rows.where(F.col("members") > SMALL_BUCKET).select("node", "n", "root").distinct(), "crowded")
    return small.unionByName(_prefix_pairs(docs, large, percent)).distinct()


def _prefix_pairs(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, root) with different roots that share a shingle early enough to be linked.

    Each set is ordered by how rare its shingles are among these nodes. Two linked sets
    share one of their first n - ceil(n * percent / 100) + 1, and behind the first that
    they share, enough must be left of both. Of a shingle's holders, those that could
    not even be linked with the smallest of them go first; if the others lie in one
    component, the shingle has no open pair, so a large group costs no pairs at all. The
    holders of a common shingle meet in one place only where pairs of them are open.
    """
    need = lambda total: total * percent  # noqa: E731  a link's intersection times (100 + percent) reaches it
    total = nodes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).where("false")
    shingles = _sets_of(docs, nodes.select("node")).select("node", F.explode("shingles").alias("s"))
    shared = shingles.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    by_rarity = Window.partitionBy("node").orderBy("f", "s")
    held = join_counted(shingles, shared, "s", "f", total).select("node", "s", F.row_number().over(by_rarity).alias("nth"), F.count("*").over(Window.partitionBy("node")).alias("c"))
    held = held.join(nodes, "node").withColumn("left", F.col("c") - F.col("nth") + 1)
    held = held.where(F.col("n") - F.col("left") + 1 <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    held = stage(held.select("s", "node", "n", "root", "left"), "prefixes")
    tidy(nodes.sparkSession)
    floor = held.groupBy("s").agg(F.min("n").alias("least"), F.count("*").alias("f"))
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    alive = stage(join_counted(held, floor, "s", "f", total).where(F.col("left") * (100 + percent) >= need(F.col("n") + partner)).drop("least", "f"), "alive")
    mixed = alive.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("f")).where("r0 <> r1").select("s", "f")
    alive = stage(join_counted(alive, mixed, "s", "f", total).drop("f"), "prefixes")
    a, b = (alive.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root", "left")]) for x in "ab")
    on = (a["s"] == b["s"]) & (a["node_a"] < b["node_b"]) & (a["root_a"] != b["root_b"]) & (F.least(a["left_a"], b["left_b"]) * (100 + percent) >= need(a["n_a"] + b["n_b"]))
    return a.join(b, on).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
