"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are centred and rotated so that the signs of the rotated values are balanced binary
codes with little quantisation error; the rotation is learned from a bounded sample.
A code is cut into substrings, one hash table each. Vectors that share a bucket in any table are
compared by exact cosine in double precision. Substring length follows the logarithm of the number
of vectors, so buckets stay small. Centring widens the angles between vectors that have a direction in
common, so the number of tables is measured: sampled vectors and partners at the threshold are
coded, and rotations are added until ``RECALL`` of them meet. When that takes more than
``MOST_TABLES``, substrings get shorter; when one bit is still too long, all vectors share one bucket and are compared
block by block, so no link is lost.

Equal vectors are one point with a multiplicity. Large buckets are cut into blocks, and pairs
of blocks are compared in tasks of bounded size; a pair counts in the first
table that brings it together.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import connected_components, stored

THRESHOLD = 0.95
#: Wanted probability that a pair at the threshold meets in a table.
RECALL = 0.98
#: Values (vectors times dimensions) the rotations are learned from, at most in expectation.
SAMPLE_VALUES = 2_000_000
ROUNDS = 40
#: Wanted vectors a bucket, and most vectors of a bucket in one block.
BUCKET, BLOCK = 32, 1000
#: Sampled pairs of each kind that recall is measured with, and tables beyond which substrings get shorter.
PAIRS, MOST_TABLES = 2000, 64


def learn_rotation(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Projection of centred rows ``x`` to ``bits`` values whose signs quantise them well.

    Principal axes, then iterative quantisation from a random rotation: alternate the
    nearest binary codes and the rotation that fits them best (orthogonal Procrustes).
    """
    rng = np.random.default_rng(seed)
    _, vec = np.linalg.eigh(x.T @ x / max(1, len(x)))
    axes = vec[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(ROUNDS):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        r = (u @ w).T
    return axes @ r


def plan_tables(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for ``n`` vectors."""
    bits = int(min(dim, 48, max(4, math.ceil(math.log2(max(2, n / BUCKET))))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def usable(c: str = "embedding"):
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(c).isNotNull() & ~bad & F.exists(c, lambda v: v != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points_of(vectors: DataFrame) -> DataFrame:
    """``k1, k2, vec_id, copies, embedding``: one row for each distinct vector (smallest id, number of rows)."""
    return vectors.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"),
                                           F.any_value("embedding").alias("embedding"))


def partners(x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at cosine ``threshold``: rows of ``x`` turned to random directions, and turned towards
    other rows, where the data vary most."""
    rng = np.random.default_rng(7)
    a = x[rng.integers(0, len(x), PAIRS)]
    out = []
    for to in (rng.standard_normal(a.shape), x[rng.integers(0, len(x), PAIRS)]):
        to = to - (to * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(to, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-6
        b = threshold * a[ok] + math.sqrt(1 - threshold ** 2) * to[ok] / size[ok]
        out.append((a[ok], b / np.linalg.norm(b, axis=1, keepdims=True)))
    return out


def code_of(x: np.ndarray, rotation: np.ndarray, bits: int) -> np.ndarray:
    """The substrings of centred rows ``x`` under one rotation."""
    return ((x @ rotation) >= 0).reshape(len(x), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _rotations(points: DataFrame, n: int, dim: int, threshold: float) -> tuple[np.ndarray, list[np.ndarray], int, int]:
    """Mean, rotations of ``dim // bits`` tables each, bits and tables, from a bounded sample.

    Tables are at least those of ``plan_tables``, and as many as the sampled pairs need to meet. Where ``MOST_TABLES`` are
    not enough the substrings get shorter, down to one bit. Where even these miss ``RECALL`` (sets of a few vectors, or vectors
    that differ by rounding only), a rotation to zero puts all vectors into one bucket, whose blocks hold every pair.
    """
    rate = min(1.0, SAMPLE_VALUES / max(1, n * dim))
    rows = points.where(F.pmod(F.xxhash64(F.lit("itq"), "k1"), F.lit(1 << 60)) < int(rate * (1 << 60))).select(
        "embedding").toArrow().column(0).to_pylist()
    x = unit(rows) if rows else np.eye(dim)
    mean = x.mean(axis=0)
    pairs = [p for p in partners(x, threshold) if len(p[0])]
    bits, tables = plan_tables(n, dim, threshold)
    while True:
        each = max(1, dim // bits)
        most = max(tables, MOST_TABLES)
        met = [np.zeros(len(a), bool) for a, _ in pairs]
        rot = []
        while len(rot) * each < most:
            rot.append(learn_rotation(x - mean, each * bits, len(rot)))
            for m, (a, b) in zip(met, pairs):
                m |= (code_of(a - mean, rot[-1], bits) == code_of(b - mean, rot[-1], bits)).any(axis=1)
            if len(rot) * each >= tables and all(m.mean() >= RECALL for m in met):
                return mean, rot, bits, len(rot) * each
        if bits == 1:
            return mean, [np.zeros((dim, 1))], 1, 1
        bits -= 1
        tables = 1


def coded(points: DataFrame, mean: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> DataFrame:
    """``vec_id, copies, embedding, codes``: the substring of every table."""
    shared = points.sparkSession.sparkContext.broadcast((mean, rotations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean_, rot = shared.value
        for b in batches:
            if not len(b):
                continue
            x = unit(b.column(2).to_pylist()) - mean_
            codes = np.concatenate([code_of(x, r, bits) for r in rot], axis=1)[:, :tables]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(codes.tolist(), pa.list_(pa.int64()))],
                names=["vec_id", "copies", "embedding", "codes"])

    kind = dict(points.dtypes)["embedding"]
    return points.select("vec_id", "copies", "embedding").mapInArrow(
        run, f"vec_id long, copies long, embedding {kind}, codes array<long>")


def bucket_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, links, root`` from every task; sum the links and connect the roots.

    A bucket of more than ``BLOCK`` vectors is cut into blocks by hash; a vector goes to each pair of
    blocks that holds its own.
    """
    t = rows.select("vec_id", "copies", "embedding", "codes", F.posexplode("codes").alias("t", "code"))
    size = t.groupBy("t", "code").agg(F.count("*").alias("c")).where("c > 1").withColumn(
        "blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    dealt = t.join(size, ["t", "code"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        "vec_id", "copies", "embedding", "codes")

    def run(key, table):
        at, _, i, j = (k.as_py() for k in key)
        ids = table.column("vec_id").to_numpy()
        own = table.column("own").to_numpy()
        copies = table.column("copies").to_numpy()
        codes = np.array(table.column("codes").to_pylist(), np.int64)
        x = unit(table.column("embedding").to_pylist())
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        step = 256
        for s in range(0, len(left), step):
            part = left[s:s + step]
            a, b = np.nonzero(x[part] @ x[right].T >= threshold)
            a, b = part[a], right[b]
            keep = (ids[a] < ids[b]) if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            # a pair that an earlier table brought together has been counted there
            new = ~(codes[a, :at] == codes[b, :at]).any(axis=1) if at else np.ones(len(a), bool)
            a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for u, v in zip(a.tolist(), b.tolist()):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        top = np.array([ids[find(v)] for v in range(len(ids))], np.int64) if len(ids) else ids
        hit = np.flatnonzero(links)
        return pa.table({"vec_id": pa.array(ids[hit]), "links": pa.array(links[hit]), "root": pa.array(top[hit])})

    return dealt.groupBy("t", "code", "i", "j").applyInArrow(run, "vec_id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id, embedding``).

    Vectors that are null or zero, hold null or non-finite components, or have no id link with
    nothing (a null id has a null component and is not kept). Vectors of different
    lengths link with nothing of the other length. Equal vectors, repeated rows too, link with
    one another. Other columns are not read. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = usable() & F.col("vec_id").isNotNull()
    good = rows.where(fit).withColumns({"k1": F.xxhash64(F.lit(1), "embedding"), "k2": F.xxhash64(F.lit(2), "embedding")})
    points = stored(points_of(good), "vector-points")
    dims = points.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()
    found = None
    for r in sorted(dims):                # one row a length; a length with one vector has no pairs
        if r.n < 2:
            continue
        of = points.where(F.size("embedding") == r.dim)
        mean, rot, bits, tables = _rotations(of, r.n, r.dim, threshold)
        part = bucket_links(stored(coded(of, mean, rot, bits, tables), "vector-codes"), threshold)
        found = part if found is None else found.unionByName(part)
    bad = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                  F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not dims:
        return bad
    if found is None:                     # no two vectors of one length
        found = vectors.sparkSession.createDataFrame([], "vec_id long, links long, root long")
    found = stored(found, "vector-links")
    comp = stored(connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))), "vector-components")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    own = points.select("k1", "k2", "vec_id", "copies").join(links, "vec_id", "left").join(
        comp.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return good.select("vec_id", "k1", "k2").join(own, ["k1", "k2"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(bad)
