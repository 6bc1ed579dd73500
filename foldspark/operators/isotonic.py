"""Distributed isotonic regression: pool adjacent violators without gathering blocks.

Fitting. Points ``(fit, x, s, n)`` (sum and count of the target at a distinct ``x``; several fits side by
side) are range-partitioned by ``(fit, x)``. Every task pools its own points into blocks of rising
means. From the smallest and largest mean of each partition (one row a partition and fit) follows which
blocks are settled: no block before them is higher and none behind them is lower, so no pooling can
reach them, and they separate what lies on either side. The other blocks are dealt out again
to half as many partitions, so that each border between two of them falls inside a task, until
none is left. Rising data settle in one round, whatever the number of blocks.

Scoring. The model is a table of blocks ``(fit, lo, hi, v)``: constant on ``[lo, hi]``, linear between blocks,
clipped at the ends. Model points and wanted ``x`` are range-partitioned together; a task finds the
neighbours of its own rows, and what it cannot see (the last model point before the partition, the first one
behind it) again comes from one row a partition.

The driver handles as many rows as there are partitions. A value that many rows share is one point.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.joins import attach_bounded
from foldspark.sources.scratch import discard, stored

#: Points that one task pools or scores.
POINTS = 500_000

BLOCKS = "part int, fit int, lo double, hi double, s double, n double"


def _parts(rows: int) -> int:
    return max(1, math.ceil(rows / POINTS))


def pooled(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks ``(fit, lo, hi, s, n)`` pooled inside ``parts`` ranges of ``(fit, lo)``; ``part`` names the range."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["fit", "lo", "hi", "s", "n"]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), type=pa.int32()),
                 *[pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)]], ["part", *names])

        now, top = None, []
        for b in batches:
            for fit, lo, hi, s, n in zip(*[b.column(c).to_pylist() for c in names]):
                if fit != now:
                    if top:
                        yield batch(top)
                    now, top = fit, []
                # a block that is lower than the one before it is merged into that
                while top and top[-1][3] * n > s * top[-1][4]:
                    _, lo, _, s0, n0 = top.pop()
                    s, n = s + s0, n + n0
                top.append((fit, lo, hi, s, n))
        if top:
            yield batch(top)

    return blocks.select("fit", "lo", "hi", "s", "n").repartitionByRange(parts, "fit", "lo").sortWithinPartitions(
        "fit", "lo").mapInArrow(run, BLOCKS)


def _outer_means(table: DataFrame) -> list[tuple]:
    """``(fit, part, highest mean before, lowest mean behind)``; one row a partition and fit is read."""
    mean = F.col("s") / F.col("n")
    rows = table.groupBy("fit", "part").agg(F.min(mean).alias("low"), F.max(mean).alias("high")).collect()
    out = []
    for fit in {r["fit"] for r in rows}:
        own = sorted((r["part"], r["low"], r["high"]) for r in rows if r["fit"] == fit)
        before, highs = -math.inf, []
        for _, _, high in own:
            highs.append(before)
            before = max(before, high)
        behind = math.inf
        for (part, low, _), high in zip(reversed(own), reversed(highs)):
            out.append((fit, part, high, behind))
            behind = min(behind, low)
    return out


def fit_isotonic(points: DataFrame) -> DataFrame:
    """The blocks ``(fit, lo, hi, v)`` of rising fits through ``(fit, x, s, n)``, a stored table.

    ``x`` is distinct within a fit and neither null nor NaN, ``n`` positive. No points give no blocks."""
    spark = points.sparkSession
    todo = stored(points.select(F.col("fit").cast("int").alias("fit"), F.col("x").alias("lo"), F.col("x").alias("hi"),
                                F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")), "iso-points")
    parts, done = _parts(todo.count()), None
    while True:
        table = stored(pooled(todo, parts), "iso-blocks")
        discard(todo)
        if parts == 1:
            last = table
        else:
            outer = spark.createDataFrame(_outer_means(table), "fit int, part int, before double, behind double")
            seen = attach_bounded(table, outer, ["fit", "part"])
            mean = F.col("s") / F.col("n")
            settled = (F.col("before") <= mean) & (mean <= F.col("behind"))
            last = seen.where(settled)
            todo = stored(seen.where(~settled).select("fit", "lo", "hi", "s", "n"), "iso-open")
        last = last.select("fit", "lo", "hi", (F.col("s") / F.col("n")).alias("v"))
        done = last if done is None else done.unionByName(last)
        if parts == 1 or not (left := todo.count()):
            return stored(done, "iso-model")
        parts = min(_parts(left), parts // 2)


def score_isotonic(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(fit, x, v)`` for the distinct ``(fit, x)`` of ``wanted``; null where the fit has no blocks."""
    spark = model.sparkSession
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    both = model.select("fit", F.explode(ends).alias("x"), "v", F.lit(False).alias("asked")).unionByName(
        wanted.select(F.col("fit").cast("int").alias("fit"), "x", F.lit(None).cast("double").alias("v"),
                      F.lit(True).alias("asked")))
    both = stored(both, "iso-asked")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        # a partition is a range of POINTS distinct values, about: it is held as arrays
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        fits, xs = table["fit"].to_numpy(), table["x"].to_numpy()
        vs, asked = table["v"].to_numpy(zero_copy_only=False), table["asked"].to_numpy(zero_copy_only=False)
        for fit in np.unique(fits):
            own = fits == fit
            mx, mv, qx = xs[own & ~asked], vs[own & ~asked], xs[own & asked]
            up = np.searchsorted(mx, qx, "left")            # first model point at or behind the value
            down = np.searchsorted(mx, qx, "right") - 1       # last model point at or before it

            def at(a, i):
                ok = (i >= 0) & (i < len(mx))
                return pa.array(a[np.where(ok, i, 0)] if len(mx) else np.zeros(len(i)), mask=~ok)

            cols = [pa.array(qx), at(mx, down), at(mv, down), at(mx, up), at(mv, up), pa.array(np.ones(len(qx), bool))]
            border = [pa.array(x, type=pa.float64()) for x in ([[None], [mx[0]], [mv[0]], [mx[-1]], [mv[-1]]] if len(mx) else [[]] * 5)]
            border.append(pa.array([False] * len(border[0]), type=pa.bool_()))
            for c in (cols, border):                        # the border row has the first and last model point
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(c[0]), type=pa.int32()), pa.array([int(fit)] * len(c[0]), type=pa.int32()), *c],
                    ["part", "fit", "x", "px", "pv", "nx", "nv", "asked"])

    near = stored(both.repartitionByRange(_parts(both.count()), "fit", "x").sortWithinPartitions("fit", "x").mapInArrow(
        run, "part int, fit int, x double, px double, pv double, nx double, nv double, asked boolean"), "iso-near")
    discard(both)
    rows = near.where(~F.col("asked")).collect()              # one row a partition and fit
    carried = []
    parts = [r["part"] for r in near.groupBy("part").count().collect()]
    for fit in {r["fit"] for r in rows}:
        own = {r["part"]: r for r in rows if r["fit"] == fit}
        before, behind, befores = (None, None), (None, None), {}
        for p in sorted(parts):
            befores[p] = before
            if p in own:
                before = (own[p]["nx"], own[p]["nv"])
        for p in sorted(parts, reverse=True):
            carried.append((fit, p, *befores[p], *behind))
            if p in own:
                behind = (own[p]["px"], own[p]["pv"])
    carry = spark.createDataFrame(carried, "fit int, part int, bx double, bv double, ax double, av double")
    t = attach_bounded(near.where("asked"), carry, ["fit", "part"])
    px, pv, nx, nv = (F.coalesce(a, b) for a, b in (("px", "bx"), ("pv", "bv"), ("nx", "ax"), ("nv", "av")))
    between = pv + (nv - pv) * (F.col("x") - px) / F.nullif(nx - px, F.lit(0.0))
    return t.select("fit", "x", F.when(px.isNull(), nv).when(nx.isNull() | (px == nx), pv).otherwise(between).alias("v"))
