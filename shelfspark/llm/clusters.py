"""Operator 13: exact k-means over whole-number vectors with Drake's adaptive bounds.

Each vector carries, from round to round, its centroid, an upper bound of the distance to it, the numbers of its next nearest centroids in
order, a lower bound for each of them and one more for all the rest. When centroids move, the upper bound grows by what its own
moved, each lower bound shrinks by what its centroid moved, the last by the farthest move of all; a bound is never above the one behind it, so that
the j-th holds for all centroids from the j-th on. A vector whose upper bound is below the first stays. Else the exact distance takes the upper bound's place, and the
first bound that is above it certifies the order from there on: only the centroids before it are measured again. If none does, all are. The number of
bounds starts at a quarter of the centroids and falls to the highest place that was needed in a round, but not below an eighth.

Distances that decide are exact: between whole numbers, in float64 as long as every sum fits its 53 bits and in 64-bit integers beyond. Bounds are compared with
a margin that covers rounding, so that a tie is never certified, but measured, and goes to the smaller number.

Each round is one pass over the vectors with their bounds, written to the shared folder in place of those of the round before; sums for each
centroid are aggregated on the JVM, combined before the shuffle, so that a centroid with a third of all vectors is no burden. Only the centroids (k rows) go through the driver.

Defined results: vectors without exactly `dims` components, or with a null or non-finite one, are left out. A vector without an id is clustered, but
is no start. Repeated vectors count each. With fewer starts than k there are fewer centroids; without any there are no rows. Components beyond 2**27 after
scaling are an error, since distances would not fit a long. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize, prepare, spread, trimmed
from shelfspark.storage import discard

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
ROWS = 4096  # vectors that are worked on at once
SMALL, LARGE = 1 << 20, 1 << 27  # components up to which float64, and 64-bit integers, are exact

_STATE = "id {id}, v array<int>, cluster int, upper double, near array<int>, lower array<double>, needed int, measured int"


def whole(df: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the vectors that are kept, as whole numbers."""
    x = F.col(vector)
    sound = (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(x.isNotNull() & sound).select(F.col(key).alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose `seed:id` has the smallest SHA-256, in that order; of one id by their components."""
    first = vectors.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in first], np.int64)


def _kind(*arrays: np.ndarray) -> type:
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    if most > LARGE:
        raise ValueError(f"a component of {most} is too large for exact distances")
    return np.float64 if most <= SMALL else np.int64


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    kind = _kind(v, c)
    v, c = v.astype(kind), c.astype(kind)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def squared_to(v: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to the centroids of its row in which."""
    kind = _kind(v, c)
    away = v.astype(kind)[:, None, :] - c.astype(kind)[which]
    return np.einsum("ijk,ijk->ij", away, away).astype(np.int64)


def _below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether upper is below lower for certain."""
    return upper * (1 + 1e-9) + 1e-6 < lower


def _ordered(lower: np.ndarray) -> np.ndarray:
    """No bound above the ones behind it."""
    return np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]


def measured_anew(v: np.ndarray, c: np.ndarray, bounds: int) -> tuple:
    """cluster, upper, near and lower from the distances to all centroids."""
    d = squared(v, c)
    order = np.argsort(d, axis=1, kind="stable")  # of equal distances the smaller number first
    near = order[:, 1 : 1 + bounds]
    rest = order[:, 1 + bounds : 2 + bounds]
    lower = np.sqrt(np.take_along_axis(d, order[:, 1 : 2 + bounds], axis=1).astype(np.float64))
    if not rest.shape[1]:
        lower = np.concatenate([lower, np.full((len(v), 1), np.inf)], axis=1)
    return order[:, 0], np.sqrt(np.take_along_axis(d, order[:, :1], axis=1)[:, 0].astype(np.float64)), near, lower


def moved(v: np.ndarray, c: np.ndarray, drift: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, bounds: int) -> tuple:
    """cluster, upper, near, lower, the place that was needed to certify the order (0: none, beyond the bounds: all), and how many distances were measured."""
    n, held = len(v), near.shape[1]
    if bounds < held:  # fewer bounds from now on: the first that goes holds for all behind it
        near, lower, held = near[:, :bounds], lower[:, : bounds + 1], bounds
    cluster, near, upper = cluster.copy(), near.copy(), upper + drift[cluster]
    lower = _ordered(np.concatenate([lower[:, :-1] - drift[near], lower[:, -1:] - drift.max()], axis=1))
    needed, measured = np.zeros(n, np.int32), np.zeros(n, np.int32)

    open_ = np.flatnonzero(~_below(upper, lower[:, 0]))
    if len(open_):
        upper[open_] = np.sqrt(squared_to(v[open_], c, cluster[open_, None])[:, 0].astype(np.float64))
        measured[open_] = 1
        open_ = open_[~_below(upper[open_], lower[open_, 0])]
    if len(open_):
        sure = _below(upper[open_, None], lower[open_])
        needed[open_] = np.where(sure.any(axis=1), sure.argmax(axis=1), held + 1)
    for j in range(1, held + 1):
        rows = np.flatnonzero(needed == j)
        if len(rows):
            which = np.concatenate([cluster[rows, None], near[rows, :j]], axis=1)
            d = squared_to(v[rows], c, which)
            order = np.lexsort((which, d), axis=1)
            which, d = np.take_along_axis(which, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
            cluster[rows], near[rows, :j], upper[rows], lower[rows, :j] = which[:, 0], which[:, 1:], d[:, 0], d[:, 1:]
            lower[rows] = _ordered(lower[rows])
            measured[rows] += j
    rows = np.flatnonzero(needed > held)
    if len(rows):
        cluster[rows], upper[rows], near[rows], lower[rows] = measured_anew(v[rows], c, held)
        measured[rows] += len(c)
    return cluster, upper, near, lower, needed, measured


def _table(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).ravel(), kind), a.shape[1]).cast(pa.list_(kind)) if a.shape[1] else pa.array([[]] * len(a), pa.list_(kind))


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, held: int, bounds: int) -> DataFrame:
    """The state of the next round; state: (id, v) at first, when before is None, and then what this gives, with so many bounds held."""
    id_type = state.schema["id"].dataType.simpleString()
    drift = None if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    dims = centroids.shape[1]
    names = ["id", "v", "cluster", "upper", "near", "lower", "needed", "measured"]
    prepare(state.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                v = _table(part.column(1), dims).astype(np.int64)
                if drift is None:
                    cluster, upper, near, lower = measured_anew(v, centroids, bounds)
                    needed, measured = np.zeros(len(v), np.int32), np.full(len(v), len(centroids), np.int32)
                else:
                    old = [part.column(i).to_numpy() for i in (2, 3)]
                    cluster, upper, near, lower, needed, measured = moved(v, centroids, drift, *old, _table(part.column(4), held) if held else np.zeros((len(v), 0), np.int32), _table(part.column(5), held + 1), bounds)
                made = [pa.array(cluster.astype(np.int32)), pa.array(upper), _lists(near.astype(np.int32), pa.int32()), _lists(lower, pa.float64()), pa.array(needed), pa.array(measured)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=names)

    read = state.select("id", "v") if drift is None else state.select("id", "v", "cluster", "upper", "near", "lower")
    return read.mapInArrow(trimmed(run), _STATE.format(id=id_type))


def updated(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The floors of the means of each centroid's vectors (an empty one stays), and the highest place among the bounds that certified."""
    dims, held = centroids.shape[1], F.size("near")
    sums = [F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(dims)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.when(F.col("needed") <= held, F.col("needed"))).alias("needed"), *sums).collect()  # a row for each centroid
    new = centroids.copy()
    for r in rows:
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return new, max((r.needed or 0 for r in rows), default=0)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, measured) after so many rounds and one more assignment, and the centroids. measured: distances that the last pass took."""
    vectors = whole(df, key, vector, dims, scale)
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return vectors.where("id IS NULL AND id IS NOT NULL").select("id", "v", F.lit(0).alias("cluster"), F.lit(0).alias("measured")), np.zeros((0, dims), np.int64)
    held = bounds = min(math.ceil(k / 4), len(centroids) - 1)
    least = min(math.ceil(k / 8), bounds)
    state, before = vectors, None
    for i in range(rounds + 1):
        after = materialize(assigned(state, centroids, before, held, bounds), "clusters")
        if i:
            discard(state)
        state, held = after, bounds
        if i < rounds:
            before = centroids
            centroids, needed = updated(state, centroids)
            bounds = held if i == 0 else max(least, min(held, needed))
    return state, centroids


def inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    spark, kept = state.sparkSession, state.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = part.column(2).to_numpy()
                d = squared_to(_table(part.column(1), centroids.shape[1]).astype(np.int64), centroids, own[:, None])[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(d)], names=["id", "cluster", "distance"])

    rows = materialize(state.select("id", "v", "cluster").mapInArrow(trimmed(run), f"id {kept}, cluster int, distance bigint"), "distances")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = cluster(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
    return inertia(state, centroids).withColumnRenamed("id", "vec_id")


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """Plain k-means: all distances in every round, component by component."""
    steps = [
        f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x : CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(v) AS x FROM w),
        f AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM w WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k}),
        c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(v) AS y FROM f)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM p JOIN c{n} USING (i) GROUP BY ALL), a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y FROM p JOIN a{n} USING (r) GROUP BY ALL), c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m{n}.y, c{n}.y) AS y FROM c{n} LEFT JOIN m{n} USING (c, i))")
    last = f"a{rounds}"
    return (
        ", ".join(steps)
        + f""", s AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST({last}.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM w JOIN {last} USING (r) JOIN s ON s.c = {last}.c"""
    )


QUERIES = {"op13_clusters": op13_clusters}
ORACLE = {"op13_clusters": _sql()}
