"""Sharding by a minimax contiguous partition of ordered atomic groups (DataFrame functions only).

Documents with equal texts form one atomic group. Groups are ordered by a hash of
their text, which is uniform whatever the sources, copies or ids look like. The
smallest feasible shard capacity is found by binary search with a greedy check,
and the cuts are hash values, so placing a document is a comparison with constants.

The search never needs all group sizes in one place. The driver holds a summary of
the ordered sizes: hash ranges ("blocks") with their bytes. A walk over blocks gives
a pessimistic and an optimistic answer; where they differ, only the blocks in which
the cuts may lie are split further by one aggregation, until the answers agree. A
summary step returns at most ``BLOCKS_PER_STEP * FAN_OUT`` rows at any data size.

Groups that are larger than an even share of what is left (a third of all rows may
be one text) come first in the order, one shard each, so the others stay near equal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, table, text_or_empty

KEY_BITS = 63
FIRST_BITS = 12
STEP_BITS = 6
BLOCKS_PER_STEP = 1024
FAN_OUT = 1 << STEP_BITS


class _Blocks:
    """Ordered blocks of the key space: start key, depth in bits, bytes, whether it is one group."""

    def __init__(self, rows):
        self.set(sorted(rows))

    def set(self, rows) -> None:
        self.rows = rows
        self.atomic = np.array([r[3] for r in rows], dtype=bool)
        self.mass = np.array([r[2] for r in rows], dtype=np.int64)
        self.cum = np.concatenate([[0], np.cumsum(self.mass)]).astype(np.int64)
        self.total = int(self.cum[-1])

    def floor(self, at: int) -> tuple[int, int, int | None]:
        """Bounds of the last group boundary <= at, and the block to split if they differ."""
        if at >= self.total:
            return self.total, self.total, None
        i = int(np.searchsorted(self.cum, at, side="right")) - 1
        low = int(self.cum[i])
        return (low, low, None) if self.atomic[i] or low == at else (low, at, i)

    def ceil(self, at: int) -> tuple[int, int, int | None]:
        """Bounds of the first group boundary >= at, and the block to split if they differ."""
        if at <= 0:
            return 0, 0, None
        i = int(np.searchsorted(self.cum, at, side="left")) - 1
        high = int(self.cum[i + 1])
        return (high, high, None) if self.atomic[i] or high == at else (at, high, i)

    def walk(self, cap: int, shards: int, optimistic: bool) -> tuple[bool, list[int]]:
        """Greedy check: fill each shard up to ``cap``; whether all fits, and the cuts."""
        at, cuts = 0, []
        for _ in range(shards):
            low, high, _ = self.floor(at + cap)
            at = high if optimistic else low
            cuts.append(at)
            if at >= self.total:
                return True, cuts
        return False, cuts

    def smallest(self, shards: int, low: int, high: int, optimistic: bool) -> int:
        """Smallest capacity in [low, high] that the walk calls feasible; high counts as feasible."""
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, optimistic)[0]:
                high = mid
            else:
                low = mid + 1
        return low

    def start_key(self, at: int) -> int:
        """Key where the group that begins after ``at`` bytes starts."""
        i = int(np.searchsorted(self.cum, at, side="left"))
        return self.rows[i][0] if i < len(self.rows) else 1 << KEY_BITS


def _summary(rows: DataFrame, bits: int):
    """One row per non-empty block of ``bits`` leading key bits."""
    block = F.shiftrightunsigned("key", KEY_BITS - bits)
    got = rows.groupBy(block.alias("block")).agg(F.sum("size").alias("mass"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    return [(r["block"] << (KEY_BITS - bits), bits, r["mass"], r["a"] == r["b"]) for r in got]


def _split(rows: DataFrame, blocks: _Blocks, which: set[int]) -> None:
    """Replace the heaviest of the named blocks by their parts."""
    chosen = sorted(which, key=lambda i: -blocks.mass[i])[:BLOCKS_PER_STEP]
    by_depth: dict[int, list[int]] = {}
    for i in chosen:
        start, bits, _, _ = blocks.rows[i]
        by_depth.setdefault(bits, []).append(start >> (KEY_BITS - bits))
    parts = []
    for bits, ids in by_depth.items():
        inside = rows.where(F.shiftrightunsigned("key", KEY_BITS - bits).isin(ids))
        parts += _summary(inside, min(KEY_BITS, bits + STEP_BITS))
    gone = set(chosen)
    blocks.set(sorted([r for i, r in enumerate(blocks.rows) if i not in gone] + parts))


def _capacity(rows: DataFrame, blocks: _Blocks, shards: int, largest: int) -> int:
    """The smallest feasible capacity, exactly."""
    low, high = max(-(-blocks.total // shards), largest), blocks.total
    while True:
        low = blocks.smallest(shards, low, high, optimistic=True)
        high = blocks.smallest(shards, low, high, optimistic=False)
        if low >= high:
            return high
        first, last = blocks.walk(low, shards, False)[1], blocks.walk(high, shards, True)[1]
        which = set()
        for k, a in enumerate(first):
            b = last[k] if k < len(last) else blocks.total
            i = max(0, int(np.searchsorted(blocks.cum, a, side="right")) - 1)
            j = int(np.searchsorted(blocks.cum, max(a, b) + high - low, side="right"))
            which |= {x for x in range(i, min(j, len(blocks.rows))) if not blocks.atomic[x]}
        _split(rows, blocks, which or {int(np.argmax(np.where(blocks.atomic, -1, blocks.mass)))})


def _cuts(rows: DataFrame, blocks: _Blocks, shards: int, cap: int) -> list[int]:
    """Cuts with every shard within ``cap``, each as near an even share of the rest as that allows."""
    while True:
        unsure: set[int] = set()

        def exact(bounds):
            if bounds[2] is not None:
                unsure.add(bounds[2])
            return bounds[0]

        latest = [blocks.total] * (shards + 1)
        for k in range(shards - 1, 0, -1):
            latest[k] = exact(blocks.ceil(latest[k + 1] - cap))
        at, cuts = 0, []
        for k in range(1, shards):
            even = at + (blocks.total - at) // (shards - k + 1)
            low, high = exact(blocks.floor(even)), exact(blocks.ceil(even))
            cut = low if even - low <= high - even else high
            if cut - at > cap:
                cut = exact(blocks.floor(at + cap))
            at = max(cut, latest[k], at)
            cuts.append(at)
        if not unsure:
            return cuts
        _split(rows, blocks, unsure)


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, slot_buckets: int = 256) -> DataFrame:
    """Place every document in one of ``shards`` shards of near-equal bytes.

    Returns (doc_id, size, text_crc32, law='bytes', shard, slot, grown_shard null). ``size`` is the
    text's UTF-8 bytes plus ``overhead``. Null and empty texts both have no bytes, crc 0,
    and form one group. Repeated rows and repeated or null ids each get their own slot.
    Slots number a shard's rows from 0 without gaps. An empty table gives no rows; other
    columns of the input are ignored.
    """
    text = text_or_empty(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"),
        ),
        "shard-rows",
    )
    top = rows.groupBy("key").agg(F.sum("size").alias("mass")).orderBy(F.desc("mass"), "key").limit(shards + 1).collect()
    heavy: list[int] = []
    total = rows.agg(F.sum("size")).first()[0] or 0
    left = total
    for r in top:
        if len(heavy) < shards - 1 and r["mass"] * (shards - len(heavy)) >= left:
            heavy.append(r["key"])
            left -= r["mass"]
        else:
            break
    rest = rows.where(~F.col("key").isin(heavy)) if heavy else rows
    starts: list[int] = []
    if left:
        blocks = _Blocks(_summary(rest, FIRST_BITS))
        free = shards - len(heavy)
        largest = next((r["mass"] for r in top if r["key"] not in heavy), 1)
        cap = _capacity(rest, blocks, free, largest)
        starts = [blocks.start_key(at) for at in _cuts(rest, blocks, free, cap)]

    last_key = (1 << KEY_BITS) - 1
    shard = reduce(lambda a, b: a + b, [(F.col("key") >= F.lit(b)).cast("int") for b in starts if b <= last_key], F.lit(len(heavy)))
    for n, key in enumerate(heavy):
        shard = F.when(F.col("key") == F.lit(key), F.lit(n)).otherwise(shard)
    placed = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(slot_buckets)).cast("int").alias("part"))

    # shards * slot_buckets rows at most, so it can be broadcast at any size
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)
