"""Centroid clustering with Hamerly's bounds, in exact integers.

Components are turned into integers, ``floor(scale * x)``. A vector keeps one upper bound of its distance
to its own centroid and one lower bound of its distance to any other. When centroids move, the upper bound
grows by the way its own centroid went, the lower bound shrinks by the longest way any other went. While
the upper bound is below the lower bound, or below half the way from its centroid to the next one, no
other centroid can be as near, so nothing is computed. Otherwise the upper bound is set to the exact distance, and a
vector that is still ambiguous is compared with all centroids in exact integers. Bounds are kept with a
margin far above the rounding of doubles, so the result is that of plain rounds, ties included.

The state is a table of integers, cluster and bounds, written once a round; the one before is removed when
its successor is complete. Vectors that change their cluster add to and take from the clusters' sums, which tasks
add up, so that at most ``k`` rows a task are shuffled and ``k`` rows reach the driver. Centroids (``k`` times
``dims`` integers, set by parameters) go to the tasks with the code. No vector is shuffled.

Defined cases: a vector that is null, of another length, or has a null or non-finite component is left
out, as is one with an integer component beyond ``LIMIT``, for which squared distances wouldn't fit
a long. Repeated rows are vectors of their own; equal ones tie in every way. A null id counts as an empty
one in the choice of the first centroids. With fewer than ``k`` vectors there are as many centroids; none
give an empty result. Centroids that lose all vectors stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import removed, small_batches, written

LIMIT = 1 << 27
#: A dot product of components below this is exact in doubles for up to 1,024 dimensions.
_EXACT = 1 << 21
_MARGIN = 1e-9

STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: integers of vectors that count, 32 bits each, little-endian."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(size == dims)
            values = pc.list_flatten(lists.take(pa.array(at)))
            x = values.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null becomes a NaN
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * float(scale))
                good = (np.abs(x) <= LIMIT).all(axis=1)
            v = np.ascontiguousarray(x[good]).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[good])), _packed(v)], ["vec_id", "v"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def _packed(v: np.ndarray) -> pa.Array:
    n, dims = v.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * dims)), pa.py_buffer(v.tobytes())])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), np.int64)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(data, "<i4", len(column) * dims, first).reshape(-1, dims).astype(np.int64)


def own(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid (ties: the smaller number), its squared distance and that of the next nearest."""
    k = len(centroids)
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if v.shape[1] <= 1024 and max(np.abs(v).max(), np.abs(centroids).max()) < _EXACT:
        dot = (v.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)  # below 2^53, so exact
        d = np.einsum("ij,ij->i", v, v)[:, None] - 2 * dot + np.einsum("ij,ij->i", centroids, centroids)[None, :]
    else:
        d = np.stack([own(v, np.broadcast_to(c, v.shape)) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    rows = np.arange(len(v))
    near = d[rows, best]
    if k == 1:
        return best, near, np.full(len(v), np.iinfo(np.int64).max)
    d[rows, best] = np.iinfo(np.int64).max
    return best, near, d.min(axis=1)


class Round(NamedTuple):
    """Centroids, how far each has moved (rounded up), and half its way to the nearest other one (rounded down)."""

    centroids: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, before: np.ndarray | None) -> Round:
        k = len(centroids)
        moved = np.zeros(k) if before is None else np.sqrt(own(centroids, before)) * (1 + _MARGIN)
        half = np.full(k, np.inf)
        for i in range(k) if k > 1 else ():
            half[i] = np.sqrt(np.delete(own(np.broadcast_to(centroids[i], centroids.shape), centroids), i).min()) / 2 * (1 - _MARGIN)
        return Round(centroids, moved, half)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after the centroids moved, and how many vectors were scanned. A cluster of -1 has none yet."""
    k = len(now.centroids)
    fresh = cluster < 0
    at = np.where(fresh, 0, cluster)
    # the longest way of any centroid but the vector's own
    order = np.argsort(-now.moved, kind="stable")
    others = np.where(at == order[0], now.moved[order[1]] if k > 1 else 0.0, now.moved[order[0]])
    upper, lower = (upper + now.moved[at]) * (1 + _MARGIN), (lower - others) * (1 - np.copysign(_MARGIN, lower - others))
    safe = np.maximum(lower, now.half[at])
    open_ = np.flatnonzero(fresh | ~(upper < safe))
    tight = open_[~fresh[open_]]
    upper[tight] = np.sqrt(own(v[tight], now.centroids[at[tight]])) * (1 + _MARGIN)
    ambiguous = open_[fresh[open_] | ~(upper[open_] < safe[open_])]
    best, near, second = scan(v[ambiguous], now.centroids)
    cluster = at.copy()
    cluster[ambiguous] = best
    upper[ambiguous], lower[ambiguous] = np.sqrt(near) * (1 + _MARGIN), np.sqrt(second) * (1 - _MARGIN)
    return cluster, upper, lower, len(ambiguous)


def _step(state: DataFrame, now: Round, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            v, was = _unpacked(b.column(1), dims), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, upper, lower, _ = assign(v, was, b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False), now)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "was", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _moves(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed cluster add to each cluster's sums and count, as Python integers."""

    def run(batches):
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = _unpacked(b.column(0), dims)
            for column, sign in ((1, 1), (2, -1)):
                to = b.column(column).to_numpy(zero_copy_only=False)
                order = np.argsort(to, kind="stable")
                order = order[to[order] >= 0]
                if len(order):
                    starts = np.flatnonzero(np.diff(to[order], prepend=-1))
                    sums[to[order][starts]] += sign * np.add.reduceat(v[order], starts, axis=0)
                    count += sign * np.bincount(to[order], minlength=k)
        some = np.flatnonzero(count.astype(bool) | sums.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], ["cluster", "n", "s"])

    parts = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was").mapInArrow(run, "cluster int, n long, s array<long>")
    # k rows of dims numbers
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))).collect()
    sums, count = np.zeros((k, dims), object), np.zeros(k, object)
    for r in rows:
        count[r["cluster"]] = r["n"]
        sums[r["cluster"]] = [int(r[f"s{i}"]) for i in range(dims)]
    return sums, count


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose seeded ids have the least SHA-256, in that order: a top-k of Spark's, so ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in rows], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    small_batches(vectors.sparkSession, 10_000)
    spark = vectors.sparkSession
    none = F.lit(-1)
    ints = written(quantised(vectors, id_col, vec_col, dims, scale), "vectors")
    centroids = first_centroids(ints, k, dims, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = ints.select("vec_id", "v", none.alias("cluster"), none.alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    behind, before = ints, None
    sums, count = np.zeros((k, dims), object), np.zeros(k, object)
    for turn in range(rounds + 1):
        state = written(_step(state, Round.of(centroids, before), dims), "state")
        removed(behind)
        behind = state
        if turn < rounds:
            add, more = _moves(state, k, dims)
            sums, count = sums + add, count + more
            before, centroids = centroids, np.array([sums[i] // count[i] if count[i] else centroids[i] for i in range(k)]).astype(np.int64)

    def distances(batches):
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own(_unpacked(b.column(1), dims), centroids[at]))], ["vec_id", "cluster", "distance"])

    found = state.select("vec_id", "v", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long")
    # k rows, so they go to every task
    per = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(i, per.get(i, 0), whole, digests[i]) for i in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same by plain rounds in SQL."""
    square = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('{seed}' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT a.r, arg_min(b.c, (CAST({square} AS BIGINT), b.c)) AS c FROM kept a, c{i} b GROUP BY a.r)")
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT c, list(q ORDER BY i) AS v FROM (SELECT d.c, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM d{i} d JOIN kept USING (r), range(1, {dims + 1}) t(i) GROUP BY d.c, i) GROUP BY c), "
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"
            )
    return (
        f"WITH {', '.join(parts)}, f AS (SELECT a.vec_id, b.c, b.v AS center, CAST({square} AS BIGINT) AS distance FROM kept a JOIN d{rounds} USING (r) JOIN c{rounds} b USING (c)) "
        "SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(center, ',')) AS centroid_sha256 FROM f"
    )


ORACLE = _oracle()
