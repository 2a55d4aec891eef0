"""Ball k-means against plain k-means in numpy."""

import hashlib

import numpy as np

from wavekin.llm import ball_kmeans as balls


def plain(ids, x, k=16, rounds=3):
    """(cluster, distance) of each row, the centroids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if r < rounds:
            for i in range(len(c)):
                if (near == i).any():
                    c[i] = x[near == i].sum(axis=0) // (near == i).sum()
    return near, d.min(axis=1), c


def test_all_vectors_equal_plain_kmeans(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], dtype=float)).astype(np.int64)
    near, d, c = plain([r["vec_id"] for r in rows], x)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    want = {r["vec_id"]: (int(n), int(v), int(d[near == n].sum()), int(d.sum()), digest[n]) for r, n, v in zip(rows, near, d, strict=True)}
    got = {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in balls.op12_ball_kmeans(spark, small).collect()}
    assert got == want


def test_clustered_vectors_need_few_distances(spark):
    rng = np.random.default_rng(2)
    home = rng.normal(size=(40, 8)) * 20
    x = np.floor(4 * (home[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8)))).astype(np.int64)
    rows = spark.createDataFrame([(i, (v / 4).tolist(), 0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cluster int, x int")
    assigned, centroids, work = balls.cluster(rows, k=40, rounds=4, dimensions=8, scale=4)
    near, d, c = plain(list(range(4000)), x, 40, 4)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in assigned.collect()}
    assert got == {i: (int(a), int(b)) for i, (a, b) in enumerate(zip(near, d, strict=True))}
    assert (centroids == c).all()
    assert work[-1] < 4000 * 40 / 8


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    base = [0.5] * 64
    rows = [
        (1, base), (1, base), (2, None), (3, []), (4, base[:63]), (5, [None, *base[1:]]), (6, [nan, *base[1:]]), (7, [inf, *base[1:]]), (8, [-inf, *base[1:]]),
        (None, base), (9, [-0.51] * 64), (10, [0.0] * 64), (11, [1e30, *base[1:]]), (12, [-(2.0**21) + 1, *base[1:]]),
    ]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    kept = [(i, v) for i, v in rows if i in (1, None, 9, 10, 12)]
    x = np.array([np.floor(64 * np.array(v)) for _, v in kept]).astype(np.int64)
    near, d, c = plain([i for i, _ in kept], x)
    assigned, centroids, _ = balls.cluster(df)
    got = balls.with_inertia(assigned, centroids).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(((i, int(n), int(v)) for (i, _), n, v in zip(kept, near, d, strict=True)), key=key)
    assert {r["inertia"] for r in got} == {int(d.sum())}
    nothing, centroids, _ = balls.cluster(df.limit(0))
    assert balls.with_inertia(nothing, centroids).count() == 0


def test_moved_radii_still_hold_all_members():
    rng = np.random.default_rng(3)
    x, a = rng.integers(-50, 50, (300, 4)), rng.integers(-40, 40, (5, 4))
    first = balls.Balls(a, [float("inf")] * 5)
    cluster, d, _ = first.assign(x, np.zeros(300, dtype=np.int64))
    b = a + rng.integers(-9, 9, a.shape)
    after = first.moved(b, [int(d[cluster == i].max(initial=0)) for i in range(5)])
    for i in range(5):
        assert (((x[cluster == i] - b[i]) ** 2).sum(axis=1) <= after.radii[i]).all()
