"""Exact k-means against plain loops and against SQL, with ties, odd vectors and few starts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import clusters
from tests.oracle import assert_same, connect


def plainly(rows, k, rounds, dims):
    """Sorted (id, cluster, distance) and the centroids, all in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    cs = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        own = [min(range(len(cs)), key=lambda c: (away(v, cs[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(cs)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    cs[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, o, away(v, cs[o])) for (i, v), o in zip(kept, own, strict=True)), key=str), cs


@pytest.mark.parametrize(("seed", "k", "dims", "step"), [(1, 12, 3, 0.25), (2, 40, 4, 0.01), (3, 1, 2, 0.1), (4, 7, 2, 1.0)])
def test_clusters_are_those_of_plain_loops(spark, seed, k, dims, step):
    """On coarse grids most distances are tied and many vectors are equal."""
    rng = random.Random(seed)
    rows = [(i // 2 if i % 10 == 0 else i, [step * rng.randint(-6, 6) for _ in range(dims)]) for i in range(250)]
    rows += [(None, [0.5] * dims), (1000, None), (1001, [0.5] * (dims - 1)), (1002, [None] + [0.5] * (dims - 1)), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", F.lit("x").alias("cluster"), F.lit(1).alias("v"))
    state, cs = clusters.cluster(df, k=k, dims=dims)
    out = clusters.inertia(state, cs).collect()
    want, centroids = plainly(rows, k, 5, dims)
    assert cs.tolist() == centroids
    assert sorted(((r.id, r.cluster, r.distance) for r in out), key=str) == want
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest() and r.cluster_inertia == sum(q.distance for q in out if q.cluster == r.cluster) for r in out)


def test_bounds_spare_distances(spark):
    """Well separated groups: the last rounds measure next to nothing."""
    rng = np.random.default_rng(3)
    middles = rng.uniform(-50, 50, (8, 16))
    rows = [(i, (middles[i % 8] + rng.normal(0, 0.2, 16)).tolist()) for i in range(800)]
    state, cs = clusters.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=8, dims=16)
    assert state.agg(F.avg("measured")).first()[0] < 2
    assert [(r.id, r.cluster) for r in state.orderBy("id").select("id", "cluster").collect()] == [(i, o) for i, o, _ in sorted(plainly(rows, 8, 5, 16)[0])]


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    v, c = (rng.integers(-clusters.LARGE, clusters.LARGE, (20, 64)) for _ in range(2))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert clusters.squared(v, c).tolist() == want
    with pytest.raises(ValueError):
        clusters.squared(v * 2, c)


def test_no_vectors_and_few_starts(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    state, cs = clusters.cluster(empty)
    assert clusters.inertia(state, cs).collect() == []
    two = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)], "vec_id bigint, embedding array<float>")
    state, cs = clusters.cluster(two)
    assert len(cs) == 3 and {r.distance for r in clusters.inertia(state, cs).collect()} == {0}


def test_embeddings_against_sql(spark, small):
    assert_same(clusters.op13_clusters(spark, small), connect(small), clusters.ORACLE["op13_clusters"])
