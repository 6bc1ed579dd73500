"""Exact Jaccard join of documents over their word shingles, as a metric-space join.

Jaccard distance is a metric, and documents link at distance ``TAU`` (0.2) or less.

* Classes: documents with equal shingle sets are one point.
* Regions: unrelated texts share nothing and lie at distance 1 from every pivot, so
  pivots alone cannot tell them apart. The first division is therefore by content: two linked sets
  share one of the first ``floor(n / 5) + 1`` shingles of either, in any fixed order (here: frequent ones last),
  and ``k`` of the first ``floor(n / 5) + k``. A point with fewer shared shingles in its longer prefix than
  its smallest partner would need links with nothing and leaves, so texts that have only a passage in
  common aren't chained. Of the others, those that share a shingle at places and with sizes that allow
  a link, directly or in a chain, form a region. No link leaves its region. Large regions are divided
  again by the same condition, their shingles in the order of exact counts, rare ones first.
* Inside a region pivots create Voronoi cells: a point within ``TAU`` of a pivot belongs to the
  first such pivot and is linked with it. By the triangle inequality whatever links with
  a point of the cell lies within ``2 * TAU`` of the pivot, so only the points of that shell are
  replicated to the cell, and there only pairs whose pivot distances differ by at
  most ``TAU`` are compared. Points in no cell form the next region, with new pivots, until none is left.

Small regions are joined in one task by the same steps. Larger ones run them as Spark jobs: pivots and
points meet in tasks of bounded size, however large the region is.
Pairs are never enumerated within a cell: its points are connected through the pivot.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import connected_components, discard, release, stored

WORDS = 5
#: A link needs NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
TAU = 1 - NUM / DEN
#: A prefix has one shingle in ``EXTRA`` of its set more than a link needs at least, and so has to share as many.
EXTRA = 20
#: Ratio of the size bands in which regions are made.
BAND = 1.06
#: Documents sampled to find frequent shingles, how many of them a frequent one is in at least, and
#: how many are remembered. They set only the order of shingles, so no result depends on them.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 20_000, 3, 500_000
#: Largest region, in points and characters of text, that one task joins.
REGION_POINTS, REGION_CHARS = 2000, 16_000_000
#: Pivots in the first round of a larger region; each further round takes eight times as many.
FIRST_PIVOTS = 64
#: Points of either side, and characters of their texts, about, that one task compares.
TASK_POINTS, TASK_CHARS = 4096, 24_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, words between ASCII white
    space, ``WORDS`` words each; fewer words: one shingle; no word: none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in found), np.uint64, len(found))
    size = min(WORDS, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15) + w[k:k + n])
    return np.unique(h)


def prefix(n: int) -> int:
    """Length of the prefix of a set of ``n``: it holds the first ``n // EXTRA + 1`` shingles that the set
    shares with any set it links with."""
    return n - -(-NUM * n // DEN) + n // EXTRA + 1


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * common >= NUM * (n + m - common)


class Points:
    """An inverted index of shingle sets, for the intersections of one set with all of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        del order
        self.start = np.flatnonzero(np.concatenate([np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]]))
        self.key = flat[self.start]
        self.stop = np.append(self.start[1:], len(flat))

    def common(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``s`` with every set."""
        out = np.zeros(len(self.sizes), np.int64)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, s), len(self.key) - 1)
            at = at[self.key[at] == s]
            lo, n = self.start[at], self.stop[at] - self.start[at]
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
            out += np.bincount(self.owner[where], minlength=len(out))
        return out


def distance(common: np.ndarray, n, m) -> np.ndarray:
    return 1 - common / (n + m - common)


def join_region(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect exactly the linked sets of one region."""
    eps = 1e-9
    edges, root = [], list(range(len(sets)))
    pts = Points(sets)
    left = np.ones(len(sets), bool)

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def join(u: int, v: int) -> None:
        edges.append((u, v))
        root[find(v)] = find(u)

    for p in range(len(sets)):
        if not left[p]:
            continue
        common = pts.common(sets[p])
        near = linked(common, pts.sizes, len(sets[p]))
        d = distance(common, pts.sizes, len(sets[p]))
        cell = np.flatnonzero(near & left)
        shell = np.flatnonzero(left & ~near & (d <= 2 * TAU + eps))
        for i in cell:
            if i != p:
                join(p, int(i))
        inside = near & left
        for y in shell.tolist():
            if find(y) == find(p):
                continue
            # the window: only points of the cell whose pivot distance is close enough
            window = inside & (d >= d[y] - TAU - eps)
            if window.any() and (window & linked(pts.common(sets[y]), pts.sizes, len(sets[y]))).any():
                join(p, y)
        left &= ~near
    return edges


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that a bounded sample of documents shows to be frequent."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64(F.lit("shingles"), "doc_id"), F.lit(1 << 20)) < int(
        min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["key", "n"])

    rows = part.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(
        F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "key").limit(MOST_FREQUENT).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def text_digest() -> list[Column]:
    return [F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")]


def points_and_keys(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row a document (``key`` null: ``doc_id, n, s1, s2`` and the text's digest ``t1, t2``) and one a prefix shingle (``key, s1, n``
    and ``pos``, the number of the set's shingles before it).

    ``s1, s2`` are a 128-bit digest of the set; both are null for a document without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "s1", "s2", "n", "doc_id", "pos", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            ids, n, s1, s2, keys = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text)
                ids.append(doc)
                n.append(len(s))
                if not len(s):
                    s1.append(None)
                    s2.append(None)
                    continue
                h = xxhash.xxh3_128_digest(s.tobytes())
                s1.append(int.from_bytes(h[:8], "big", signed=True))
                s2.append(int.from_bytes(h[8:], "big", signed=True))
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    s = np.concatenate([s[often[at] != s], s[often[at] == s]])
                keys.append((s[:prefix(n[-1])].view(np.int64), s1[-1], n[-1]))
            rows = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(ids, pa.int64()), pa.nulls(rows, pa.int32()), b.column(2), b.column(3)], names=names)
            if keys:
                size = [len(k) for k, _, _ in keys]
                key = np.concatenate([k for k, _, _ in keys])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.repeat([s for _, s, _ in keys], size)), pa.nulls(len(key), pa.int64()),
                     pa.array(np.repeat([m for _, _, m in keys], size)), pa.nulls(len(key), pa.int64()),
                     pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in size])),
                     pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64())], names=names)

    return docs.select("doc_id", "text", *text_digest()).mapInArrow(
        run, "key long, s1 long, s2 long, n long, doc_id long, pos int, t1 long, t2 long")


def regions(keys: DataFrame, copies: DataFrame) -> DataFrame:
    """``node, component``: classes that share a prefix shingle and may link, directly or in a chain.
    ``keys``: ``key, s1, n, pos``, as often as ``copies`` (``s1, copies``) says.

    Two linked sets have the first ``m // EXTRA + 1`` of their common shingles in both prefixes, m the smaller
    size, which is at least 4/5 of n. A class with fewer shared prefix shingles has no link.

    Let ``key`` be the first shingle that x and y share. The ``pos`` shingles of x before it are not in
    y, so at most ``n - pos`` are common; a link needs 4/9 of both sizes together. So
    y has at most ``(n - pos) * 9/4 - n`` shingles, besides 4/5 to 5/4 of x's. Each entry goes to the
    cells (its size band, a band it may link with); a cell connects its classes if both of its bands
    are there. At least one end of a link has ``pos <= n / 9``.
    """
    def band(n) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(BAND)) + 1e-9).cast("int")

    shared = keys.groupBy("key").agg(
        F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.max((F.col("pos") * (NUM + DEN) <= F.col("n") * (DEN - NUM)).cast(
            "int")).alias("early")).where("lo < hi").select("key", "early")
    entries = stored(keys.join(shared, "key"), "shared-entries")
    release(keys.sparkSession)
    least = F.ceil(F.col("n") * NUM / DEN)
    most = F.least(F.floor(F.col("n") * DEN / NUM), F.floor((F.col("n") - F.col("pos")) * (NUM + DEN) / NUM) - F.col("n"))
    enough = entries.groupBy("s1").agg(F.count("*").alias("found"), F.max("n").alias("n")).join(copies, "s1").where(
        F.col("found") >= F.col("copies") * (F.floor(least / EXTRA) + 1)).select("s1")
    # a first common shingle lies before the extra ones; the size left over for y says so, too
    cand = stored(entries.where((F.col("early") == 1) & (most >= least)).join(enough, "s1", "left_semi").select(
        "key", "s1", band(F.col("n")).alias("own"), band(least).alias("from"), band(most).alias("to")), "shared-keys")
    discard(entries)
    release(keys.sparkSession)
    cells = cand.select("key", "s1", "own", F.explode(F.sequence("from", "to")).alias("b")).select(
        "key", "s1", F.least("own", "b").alias("b1"), F.greatest("own", "b").alias("b2"),
        F.signum(F.col("own") - F.col("b")).cast("int").alias("side"))
    low = cells.groupBy("key", "b1", "b2").agg(
        F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("side").alias("first"), F.max("side").alias("last")).where(
        "lo < hi and (b1 = b2 or first < last)").select("key", "b1", "b2", "lo")
    edges = stored(cells.join(low, ["key", "b1", "b2"]).where("s1 <> lo").select(
        F.col("s1").alias("a"), F.col("lo").alias("b")).distinct(), "shared-edges")
    discard(cand)
    release(keys.sparkSession)
    return connected_components(edges, "regions")


def divided(points: DataFrame) -> DataFrame:
    """``s1, region`` of the points of large regions (``s1, text``) that may link with another, in smaller regions.

    All shingles are counted, and a prefix takes the rarest: first those that no other point has, then those
    of a text's own copies. A passage that many texts have in common comes last and connects nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s1, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), s1, np.int64)),
                                                  pa.array(np.full(len(s), len(s), np.int64))], names=["key", "s1", "n"])

    every = stored(points.select("s1", "text").mapInArrow(run, "key long, s1 long, n long"), "region-shingles")
    counts = every.groupBy("key").agg(F.count("*").alias("c"), F.min("s1").alias("lo"), F.max("s1").alias("hi")).where(
        "lo < hi").select("key", "c")
    # repeated rows of a point count once
    shared = every.join(counts, "key").dropDuplicates(["key", "s1"])
    of = Window.partitionBy("s1")
    alone = F.col("n") - F.count("*").over(of)
    keys = shared.select("key", "s1", "n", (alone + F.row_number().over(of.orderBy("c", "key")) - 1).cast("int").alias("pos"))
    keys = stored(keys.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * NUM / DEN) + F.floor(F.col("n") / EXTRA) + 1),
                  "region-keys")
    discard(every)
    release(points.sparkSession)
    out = regions(keys, points.select("s1", F.lit(1).alias("copies")).distinct())
    discard(keys)
    return out.select(F.col("node").alias("s1"), F.col("component").alias("region"))


def join_small(points: DataFrame) -> DataFrame:
    """``a, b`` edges of regions that fit one task. ``points``: ``region, s1, text``."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("s1").to_pylist()
        sets = [shingles(t) for t in table.column("text").to_pylist()]
        edges = join_region(sets)
        return pa.table({"a": pa.array([ids[i] for i, _ in edges], pa.int64()),
                         "b": pa.array([ids[j] for _, j in edges], pa.int64())})

    return points.select("region", "s1", "text").groupBy("region").applyInArrow(run, "a long, b long")


def meet(points: DataFrame, others: DataFrame, key: str, links_only: bool = False) -> DataFrame:
    """Every point against the others of its ``key``, in tasks of bounded size.

    Both tables: ``key, s1, text, d, known``. Gives ``s1, other, common, n, m`` for pairs at distance
    ``2 * TAU`` or less whose pivot distances ``d`` (null: not known) differ by at most ``TAU`` and that
    aren't connected yet (``known`` differs or is null). With ``links_only``, only links count, and for each
    point one to every group of others that is connected already.

    The points of a key are dealt to salts and its others to blocks, by hash; a task has one salt and
    one block, so a hot key is spread over many.
    """
    share = F.ceil(F.greatest(F.count("*") / TASK_POINTS, F.sum(F.length("text")) / TASK_CHARS))
    deal = points.groupBy(key).agg(share.alias("salts")).join(others.groupBy(key).agg(share.alias("blocks")), key)
    names = ["s1", "text", "d", "known"]
    left = points.select(key, *names).join(deal, key).select(
        key, *names, F.pmod(F.xxhash64(F.lit("salt"), "s1"), F.col("salts")).alias("salt"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = others.select(key, *names).join(deal, key).select(
        key, *names, F.pmod(F.xxhash64(F.lit("block"), "s1"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))

    def run(left, right):
        pts = Points([shingles(t) for t in right.column("text").to_pylist()])
        ids, comps = right.column("s1").to_pylist(), right.column("known").to_pylist()
        ds = np.array([np.nan if d is None else d for d in right.column("d").to_pylist()], float)
        out = []
        for s1, text, d, comp in zip(*[left.column(c).to_pylist() for c in names]):
            s = shingles(text)
            common = pts.common(s)
            hit = linked(common, pts.sizes, len(s)) if links_only else distance(common, pts.sizes, len(s)) <= 2 * TAU + 1e-9
            if d is not None:
                hit &= ~(np.abs(ds - d) > TAU + 1e-9)
            done = set()
            for i in np.flatnonzero(hit).tolist():
                if ids[i] == s1 or (comp is not None and comp == comps[i]) or (links_only and comps[i] in done):
                    continue
                done.add(ids[i] if comps[i] is None else comps[i])
                out.append((s1, ids[i], int(common[i]), len(s), int(pts.sizes[i])))
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["s1", "other", "common", "n", "m"])

    by = [key, "block", "salt"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        run, "s1 long, other long, common long, n long, m long")


def join_large(points: DataFrame) -> DataFrame | None:
    """``a, b`` edges of regions too large for one task. ``points``: ``region, s1, text``, stored."""
    link = f"{DEN} * common >= {NUM} * (n + m - common)"
    far = 1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    void = {"d": F.lit(None).cast("double"), "known": F.lit(None).cast("long")}
    left, pivots, edges = points, FIRST_PIVOTS, None
    while left.limit(1).count():
        # pivots: a bounded number of each region's points, the first in the order of a hash
        first = left.select("region", "s1", "text").withColumn("o", F.xxhash64(F.lit(pivots), "s1"))
        count = first.groupBy("region").agg(F.count("*").alias("c"))
        few = first.join(count, "region").where((F.col("c") <= 2 * pivots) | (F.pmod("o", F.col("c")) < 2 * pivots))
        chosen = stored(few.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy("o", "s1"))).where(
            F.col("r") <= pivots).select("region", "s1", "text", "r"), "pivots")
        near = stored(meet(left.withColumns(void), chosen.withColumns(void), "region"), "near")
        release(points.sparkSession)
        linked_ = near.where(link)
        found = linked_.select(F.col("s1").alias("a"), F.col("other").alias("b"))
        # cells: a point belongs to its first pivot. Labels: points with one label are connected for certain
        rank = chosen.select(F.col("s1").alias("other"), "r")
        home = stored(linked_.join(rank, "other").groupBy("s1").agg(
            F.min(F.struct("r", F.col("other").alias("pivot"), far.alias("d"))).alias("h")).select(
            "s1", "h.pivot", "h.d"), "cells")
        own = chosen.join(home.select("s1", F.col("pivot").alias("first")), "s1", "left").select(
            "s1", F.least("s1", F.coalesce("first", "s1")).alias("label"))
        label = stored(linked_.join(own.select(F.col("s1").alias("other"), "label"), "other").select("s1", "label").unionByName(
            own).groupBy("s1").agg(F.min("label").alias("known")), "labels")
        shell = near.where(f"not ({link})").select("s1", F.col("other").alias("pivot"), far.alias("d"))
        shell = stored(shell.join(label, "s1", "left").join(label.select(
            F.col("s1").alias("pivot"), F.col("known").alias("pivot_known")), "pivot", "left").where(
            "known is null or known <> pivot_known").select("s1", "pivot", "d"), "shells")
        # windows: of a cell, the points far enough from the pivot to reach its shell. Every point of a
        # shell or window goes to its region's tasks once, however many cells it borders on
        reach = shell.groupBy("pivot").agg(F.min("d").alias("closest"))
        window = home.unionByName(chosen.select("s1", F.col("s1").alias("pivot"), F.lit(0.0).alias("d"))).join(
            reach, "pivot").where(F.col("d") >= F.col("closest") - TAU - 1e-9)
        text = left.join(label, "s1", "left").withColumn("d", F.lit(None).cast("double"))
        inner = stored(text.join(window.select("s1").distinct(), "s1", "left_semi"), "cell-points")
        outer = stored(text.join(shell.select("s1").distinct(), "s1", "left_semi"), "shell-points")
        across = meet(outer, inner, "region", links_only=True)
        found = found.unionByName(across.select(F.col("s1").alias("a"), F.col("other").alias("b")))
        old = [t for t in (edges, left if left is not points else None) if t is not None]
        edges = stored(found.distinct() if edges is None else edges.unionByName(found).distinct(), "edges")
        covered = home.select("s1").unionByName(chosen.select("s1")).distinct()
        left = stored(left.join(covered, "s1", "left_anti").select("region", "s1", "text"), "left")
        for table in (*old, chosen, near, home, label, shell, inner, outer):
            discard(table)
        release(points.sparkSession)
        pivots *= 8
    return edges


def large_regions(points: DataFrame) -> DataFrame:
    """``region`` of those too large for one task. ``points``: ``region, text``."""
    extent = points.groupBy("region").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"))
    return stored(extent.where((F.col("points") > REGION_POINTS) | (F.col("chars") > REGION_CHARS)).select("region"), "big")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable by links. Texts without words (null
    too) have 0 shingles and link with nothing. Repeated rows are copies like any others; a null doc_id is
    a point, but never a component's id unless its component has no other. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(points_and_keys(docs, frequent_shingles(docs)), "shingle-keys")
    every = stored(rows.where("key is null").select("doc_id", "n", "s1", "s2", "t1", "t2"), "points")
    classes = stored(every.where("s1 is not null").groupBy("s1").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row"),
        F.min("s2").alias("lo"), F.max("s2").alias("hi"), F.count("*").alias("copies")), "classes")
    if classes.where("lo <> hi").limit(1).count():
        raise ValueError("two different shingle sets share a 64-bit digest; change the seed of the digest")
    region = stored(regions(rows.where("key is not null").select("key", "s1", "n", "pos"), classes.select("s1", "copies")),
                    "region-of")
    discard(rows)
    # a class's text is that of one of its rows, found by id and digest: an id may have several texts, or be null
    members = region.join(classes.select(F.col("s1").alias("node"), "row.doc_id", "row.t1", "row.t2"), "node").select(
        F.col("node").alias("s1"), F.col("component").alias("region"), F.col("doc_id").alias("d"), "t1", "t2")
    known = docs.select("doc_id", "text", *text_digest())
    known = known.where("doc_id is not null").unionByName(known.where("doc_id is null").dropDuplicates(["t1", "t2"]))
    texts = known.join(members, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("d"))).select("region", "s1", "text")
    texts = stored(texts, "region-texts")
    release(docs.sparkSession)
    big = large_regions(texts)
    edges = stored(join_small(texts.join(big, "region", "left_anti")), "small-edges")
    large = stored(texts.join(big, "region", "left_semi"), "big-texts")
    discard(texts)
    discard(big)
    part = stored(divided(large), "divided")
    again = stored(large.select("s1", "text").join(part, "s1").select("region", "s1", "text"), "divided-texts")
    discard(large)
    discard(part)
    big = large_regions(again)
    more = stored(join_small(again.join(big, "region", "left_anti")), "more-edges")
    large = stored(again.join(big, "region", "left_semi"), "big-texts")
    discard(again)
    far = join_large(large)
    near = edges.unionByName(more)
    found = stored(connected_components(near if far is None else near.unionByName(far), "links"), "classes-linked")
    for table in (classes, region, big, large, edges, more, far):
        discard(table)
    release(docs.sparkSession)
    joined = every.where("s1 is not null").join(found, F.col("s1") == F.col("node"), "left").select(
        "doc_id", "n", F.coalesce("component", "s1").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = joined.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(every.where("s1 is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
