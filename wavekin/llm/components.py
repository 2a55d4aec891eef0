"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, passing, remove, stage, tidy


def _state(edges: DataFrame) -> tuple[int, int]:
    """Edges (u, v), and the nodes that keep them from being stars: with several v, or a v that has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    row = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.sum("up"), F.count_if(F.expr("up > 0 and up + down > 1"))).first()
    return row[0] or 0, row[1]


def _with_least(edges: DataFrame, total: int, *others) -> DataFrame:
    """``edges`` (u, v) with m, the smallest v of their u or of ``others``; a hub's edges are not brought together."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    low = low.select("u", F.least("m", *others).alias("m") if others else "m", "degree")
    return join_counted(edges, low, "u", "degree", total).drop("degree")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every node that is not its component's smallest, root being that smallest; staged.

    ``edges`` has columns (u, v); direction, repeats and loops do not matter. Each round
    hangs every node under its smallest neighbour, then neighbours under the smallest of
    them, so paths shorten to stars in a number of rounds that grows with the logarithm
    of their length; edges that are stars already take none. All rounds are aggregations
    with map-side combining and joins in which the edges of a hub stay spread over all tasks.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(max_rounds):
        total, open_ = _state(now)
        if not open_:
            out = now.select("u", F.col("v").alias("root"))
            out.staged_path = now.staged_path
            return out
        with passing(now.sparkSession) as keep:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _with_least(both, 2 * total, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            hung = _with_least(large, 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            old, now = now, keep(stage(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc"))
        del both, large, hung, least
        remove(now.sparkSession, old.staged_path)
        # a round's plans would stay with the driver until its heap is full
        tidy(now.sparkSession)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
