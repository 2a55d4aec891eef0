"""Ball k-means: exact k-means over whole numbers that compares few vectors with few centroids.

A cluster is a ball: a centroid and a radius that no member exceeds. With centroids c, c'
and a member x of c's cluster, c' can only be as near as c if |c - c'| <= 2 |x - c|. So

* c' is a neighbour of c only if |c - c'| <= 2 * radius;
* sorted by distance, the neighbours cut the ball into a core around c, whose members are
  stable, and annuli: a member of the m-th annulus is compared with the first m neighbours.

Everything is in integers (squared distances), so results equal a full comparison exactly. The
radius after a centroid has moved is bounded by the old radius plus the move. Each round is one map over
the vectors; the driver holds the centroids and one row a cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, remove, stage, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components from which on squared distances of 64 components may leave a long.
LIMIT = 1 << 21


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) as longs; vectors of another length, or with null or non-finite components, are left out.

    So are those with a component of 2^21 or more, whose squared distances need more than a long.
    """
    v = F.col("embedding")
    ok = (F.size(v) == dimensions) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LIMIT))
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest sha256 of 'seed:vec_id', in that order; equal ids by their components, a null id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["x"] for r in vectors.orderBy(F.asc_nulls_last(digest), "x").limit(k).collect()], dtype=np.int64)


@dataclass
class Balls:
    """Centroids with bounds of the squared radii of their clusters (infinite where nothing is known)."""

    centroids: np.ndarray
    radii: list[float]

    def __post_init__(self):
        c = self.centroids
        between = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        self.neighbours, self.reach = [], []
        for i, row in enumerate(between):
            order = np.lexsort((np.arange(len(c)), row))
            near = order[(order != i) & (row[order] <= 4 * self.radii[i])]
            self.neighbours.append(near)
            self.reach.append(row[near])

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest cluster, squared distance, distances computed) of rows whose clusters were ``cluster``; ties go to the smaller number."""
        best, out = np.empty(len(x), dtype=np.int64), cluster.copy()
        computed = len(x)
        for i in np.unique(cluster):
            at = np.flatnonzero(cluster == i)
            own = ((x[at] - self.centroids[i]) ** 2).sum(axis=1)
            annulus = np.searchsorted(self.reach[i], 4 * own, side="right")
            near, to = own.copy(), np.full(len(at), i)
            for m, j in enumerate(self.neighbours[i]):
                open_ = np.flatnonzero(annulus > m)
                if not len(open_):
                    break
                d = ((x[at[open_]] - self.centroids[j]) ** 2).sum(axis=1)
                computed += len(open_)
                better = (d < near[open_]) | ((d == near[open_]) & (j < to[open_]))
                near[open_[better]], to[open_[better]] = d[better], j
            best[at], out[at] = near, to
        return out, best, computed

    def moved(self, centroids: np.ndarray, radii: list[int]) -> Balls:
        """The balls after their centroids have moved, with the members' largest distances to the old ones."""
        step = ((centroids - self.centroids) ** 2).sum(axis=1)
        return Balls(centroids, [(math.isqrt(int(r)) + math.isqrt(int(s)) + 2) ** 2 if s else int(r) for r, s in zip(radii, step, strict=True)])


_ASSIGNED = "vec_id long, x array<long>, cluster int, distance long, computed long"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def assign(vectors: DataFrame, balls: Balls) -> DataFrame:
    """``vectors`` (vec_id, x, cluster) with their nearest centroids; computed is the number of distances of a batch, on its first row."""
    held = vectors.sparkSession.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance, computed = held.value.assign(_matrix(batch.column("x")), batch.column("cluster").to_numpy().astype(np.int64))
            work = np.zeros(len(cluster), dtype=np.int64)
            work[0] = computed
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(work)], ["vec_id", "x", "cluster", "distance", "computed"])

    return vectors.select("vec_id", "x", "cluster").mapInArrow(run, _ASSIGNED)


def _sums(assigned: DataFrame, dimensions: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """Cluster -> (members, largest distance, summed components). Tasks add up their own rows first; the driver gets a row for each cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster, distance = _matrix(batch.column("x")), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            for i in np.unique(cluster):
                at = cluster == i
                n, r, s = held.get(int(i), (0, 0, 0))
                held[int(i)] = [n + int(at.sum()), max(r, int(distance[at].max())), s + x[at].sum(axis=0)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array([v[c] for v in held.values()], pa.int64()) for c in (0, 1)), pa.array([v[2].tolist() for v in held.values()], pa.list_(pa.int64()))], ["cluster", "n", "radius", "sums"])

    per_task = assigned.select("x", "cluster", "distance").mapInArrow(run, "cluster int, n long, radius long, sums array<long>")
    spread = per_task.select("cluster", "n", "radius", F.posexplode("sums").alias("pos", "s"))
    out: dict[int, tuple[int, int, np.ndarray]] = {}
    for r in spread.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("s").alias("s")).collect():
        out.setdefault(r["cluster"], (r["n"], r["radius"], np.zeros(dimensions, dtype=np.int64)))[2][r["pos"]] = r["s"]
    return out


def cluster(rows: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, cluster, distance) of every kept vector, staged; the centroids; distances computed by round).

    Each round assigns all vectors and replaces every centroid that has members by the floor of their
    mean; then vectors are assigned once more. Rows that repeat a vec_id are vectors of their own. With fewer
    than k vectors there are as many centroids as vectors; an empty table gives no rows.
    """
    spark, work = rows.sparkSession, []
    with passing(spark) as keep:
        vectors = whole_vectors(rows, dimensions, scale)
        centroids = first_centroids(vectors, k, seed)
        if not len(centroids):
            empty = vectors.limit(0).select("vec_id", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance"))
            return empty, np.zeros((0, dimensions), dtype=np.int64), [0] * (rounds + 1)
        # all vectors begin in the ball of centroid 0, of which nothing is known
        now, balls = vectors.withColumn("cluster", F.lit(0)), Balls(centroids, [math.inf] * len(centroids))
        for r in range(rounds + 1):
            last = r == rounds
            done = assign(now, balls)
            staged = stage(done.drop("x") if last else done, "balls")
            work.append(staged.agg(F.sum("computed")).first()[0])
            if r:
                remove(spark, now.staged_path)
            now = staged
            if not last:
                sums = _sums(now, dimensions)
                fresh = np.array([sums[i][2] // sums[i][0] if i in sums else c for i, c in enumerate(balls.centroids)])
                balls = balls.moved(fresh, [sums[i][1] if i in sums else 0 for i in range(len(fresh))])
        return keep(now).select("vec_id", "cluster", "distance"), balls.centroids, work


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(per.values())
    told = [(i, s, total, hashlib.sha256(",".join(str(int(c)) for c in centroids[i]).encode()).hexdigest()) for i, s in per.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    assigned, centroids, _ = cluster(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, centroids)
