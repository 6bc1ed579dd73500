"""Centroid clustering on an exact, incrementally updated distance matrix (operator 11).

Vectors become integers, ``floor(scale * x)``. Each keeps its squared norm and its dot product with
every centroid as 64-bit integers. When centroids move, a dot product changes only by
the components in which its centroid changed: ``dot += change . x`` over the non-zero
changes. A distance is ``|x|^2 - 2 dot + |c|^2``, the assignment its smallest (ties: the smaller
number). No distance is ever computed anew, and none is rounded.

The state (id, integers, norm, dots, cluster) is written to the shared folder each round,
so a lost executor costs one round's tasks and the plan does not grow. A round sends to the
driver one row a cluster (count and component sums, added up before the shuffle); centroids
and their changes go back inside the tasks. Both are ``k * dims`` numbers, whatever the table's size. A
cluster that holds most rows is a partial sum a task.

Defined cases: vectors that are null, of another length or hold null, NaN or infinite components
are left out. Rows are a multiset: repeated ones count each time. A row without id is clustered like
others but never starts as a centroid. Starting centroids with equal hashes (repeated ids) come in
order of their components. Fewer kept vectors than ``k`` give as many centroids; a table
without a kept vector that has an id gives an empty result. Components beyond ``LIMIT`` after scaling raise an error, since their squared
distances would leave 64 bits. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import discard, stored

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Largest absolute value of a component: 64 squared differences of twice this fit a long.
LIMIT = 1 << 27


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """``(id, v)`` of the vectors that take part."""
    out = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return out.where(F.col("v").isNotNull() & (F.size("v") == dims)).where(finite)


def quantise(v: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * v)`` of a matrix of doubles."""
    q = np.floor(scale * v.astype(np.float64))
    if q.size and np.abs(q).max() > LIMIT:
        raise ValueError(f"a scaled component exceeds {LIMIT}; its squared distances do not fit 64 bits")
    return q.astype(np.int64)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def first_centroids(kept: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in order of their hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.where("id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return quantise(np.array([r["v"] for r in rows], dtype=np.float64), scale)


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(centroid, components, by how much)`` for each centroid that moved."""
    out = []
    for j, row in enumerate(new - old):
        at = np.flatnonzero(row)
        if len(at):
            out.append((j, at, row[at]))
    return out


def advance(kept: DataFrame, moves: list, norms: np.ndarray, scale: int, first: bool) -> DataFrame:
    """The state after the centroids' moves: dots updated, distances and clusters read off them.

    ``first``: ``kept`` holds raw vectors, whose dots with centroids at the origin are 0."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if first:
                x = quantise(matrix(b.column("v"), n), scale)
                norm, dots = (x * x).sum(1), np.zeros((n, len(norms)), dtype=np.int64)
            else:
                x = matrix(b.column("x"), n).astype(np.int64)
                norm, dots = np.asarray(b.column("norm")), matrix(b.column("dots"), n).copy()
            for j, at, by in moves:
                dots[:, j] += x[:, at] @ by
            far = norm[:, None] - 2 * dots + norms[None, :]
            cluster = far.argmin(1)

            def lists(m, kind):
                ends = pa.array(np.arange(0, m.size + 1, m.shape[1]), type=pa.int32())
                return pa.ListArray.from_arrays(ends, pa.array(m.ravel(), type=kind))

            yield pa.RecordBatch.from_arrays(
                [b.column("id"), lists(x, pa.int32()), pa.array(norm, type=pa.int64()), lists(dots, pa.int64()),
                 pa.array(cluster, type=pa.int32()), pa.array(far[np.arange(n), cluster], type=pa.int64())],
                ["id", "x", "norm", "dots", "cluster", "distance"])

    kind = dict(kept.dtypes)["id"]
    return kept.mapInArrow(step, f"id {kind}, x array<int>, norm bigint, dots array<bigint>, cluster int, distance bigint")


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid at the floor of its vectors' mean; one row a cluster reaches the driver."""
    dims = centroids.shape[1]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), *[
        F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)]).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
                    seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector."""
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col, dims)
    at = first_centroids(kept, k, scale, seed)
    kind = dict(kept.dtypes)["id"]
    if not len(at):                      # no vector has an id: nothing to start from
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    before, state = np.zeros_like(at), kept
    for i in range(rounds + 1):
        new = stored(advance(state, changes(before, at), (at * at).sum(1), scale, i == 0), "cluster-state")
        if i:
            discard(state)
        state = new
        if i < rounds:
            before, at = at, moved(state, at)
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    report = spark.createDataFrame(
        [(j, s, total, hashlib.sha256(",".join(map(str, at[j].tolist())).encode()).hexdigest())
         for j, s in sorted(sums.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a cluster
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(report), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
