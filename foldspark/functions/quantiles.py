"""Exact distributed quantiles (numpy's linear rule).

Spark's exact percentile keeps a value -> count map per group and merges it in one
task. Here every step is spread over the cluster:

1. rows are aggregated to counts per (keys, value), with map-side combine, so a hot
   value is one row;
2. the counts are range-partitioned by (keys, value) and written once;
3. sums per (keys, partition) say in which partition each wanted rank lies;
4. only those partitions' rows of a key are numbered, and the ranks picked.

``weights`` give several counts per value (variants), for instance "all folds but f"
for every f, so that one pass serves all of them. Nulls and NaN are left out; a group
without values has no row (a null median after a left join).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.sources.scratch import discard, stored


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
              weights: Sequence[Column] = ()) -> DataFrame:
    """``keys..., variant, q0, q1, ...``: the quantiles ``qs`` of ``value`` per key and variant.

    ``weights`` are integer columns (0: the row does not count for that variant);
    none: one variant that counts every row. The result is a stored table with one row
    per key and variant.
    """
    keys, qs = list(keys), [float(q) for q in qs]
    weights = list(weights) or [F.lit(1)]
    w = [f"__w{j}" for j in range(len(weights))]
    x = rows.select(*keys, F.col(value).cast("double").alias("__v"),
                    *[c.cast("long").alias(n) for c, n in zip(weights, w)])
    # -0.0 and 0.0 are one value
    x = x.where(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn("__v", F.col("__v") + F.lit(0.0))
    counts = x.groupBy(*keys, "__v").agg(*[F.sum(c).alias(c) for c in w])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(parts, *keys, "__v").withColumn("__pid", F.spark_partition_id()),
                    "quantile-counts")
    variants = F.explode(F.array(*[F.struct(F.lit(j).alias("variant"), F.col(c).alias("w"))
                                   for j, c in enumerate(w)]))
    sums = ranged.groupBy(*keys, "__pid").agg(*[F.sum(c).alias(c) for c in w]).select(
        *keys, "__pid", variants.alias("x")).select(*keys, "__pid", "x.variant", "x.w")
    # one row per key, partition and variant: windows over at most `parts` rows
    per = Window.partitionBy(*keys, "variant")
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(
        per.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "total", F.sum("w").over(per))
    pos = [(F.col("total") - 1) * F.lit(q) for q in qs]
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(hi).alias("hi"),
                                        (F.ceil(p) if hi else F.floor(p)).cast("long").alias("rank"),
                                        (p - F.floor(p)).alias("frac"))
                               for i, p in enumerate(pos) for hi in (0, 1)]))
    targets = sums.select(*keys, "__pid", "variant", "w", "before", want.alias("t")).select(
        *keys, "__pid", "variant", "w", "before", "t.*").where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("w")))
    targets = stored(targets.drop("w"), "quantile-targets")
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    touched = targets.select(*named, F.col("__pid").alias("__tp")).distinct()
    same = F.col("__pid") == F.col("__tp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows_ = ranged.join(touched, same, "left_semi").select(*keys, "__pid", "__v", variants.alias("x")).select(
        *keys, "__pid", "__v", "x.variant", "x.w").where("w > 0")
    run = Window.partitionBy(*keys, "__pid", "variant").orderBy("__v")
    rows_ = rows_.withColumn("upto", F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    t = targets.select(*named, F.col("__pid").alias("__tp"), F.col("variant").alias("__tv"), "before", "q", "hi",
                       "rank", "frac")
    hit = rows_.join(t, same & (F.col("variant") == F.col("__tv"))
                     & (F.col("rank") - F.col("before") < F.col("upto"))
                     & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("w")))

    def at(i: int, hi: int, c: str) -> Column:
        return F.max(F.when((F.col("q") == i) & (F.col("hi") == hi), F.col(c)))

    out = stored(hit.groupBy(*keys, "variant").agg(
        *[(at(i, 0, "__v") + (at(i, 1, "__v") - at(i, 0, "__v")) * at(i, 0, "frac")).alias(f"q{i}")
          for i in range(len(qs))]), "quantiles")
    discard(ranged)
    discard(targets)
    return out


def column_quantiles(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = (),
                     qs: Sequence[float] = (0.5,), weights: Sequence[Column] = ()) -> DataFrame:
    """``col, by..., variant, q0, ...`` for several columns in one pass (they are stacked)."""
    w = {f"__s{j}": c for j, c in enumerate(weights)}
    kv = F.explode(F.array(*[F.struct(F.lit(n).alias("col"), c.cast("double").alias("v"))
                             for n, c in values.items()]))
    long = df.select(*by, *[c.cast("long").alias(n) for n, c in w.items()], kv.alias("kv")).select(
        "kv.col", "kv.v", *by, *w)
    return quantiles(long, ["col", *by], "v", qs, [F.col(n) for n in w])


def with_quantiles(df: DataFrame, by: Sequence[str], aggs: Sequence[Column],
                   wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """``df.groupBy(by).agg(aggs)`` plus one exact quantile column per ``wanted`` name."""
    by = list(by)
    out = df.groupBy(*by).agg(*aggs)
    values: dict[str, Column] = {}
    for c, _ in wanted.values():
        values.setdefault(str(c), c)
    qs = sorted({q for _, q in wanted.values()})
    names = {text: f"v{i}" for i, text in enumerate(values)}
    table = column_quantiles(df, {names[t]: c for t, c in values.items()}, by, qs)
    picks = [F.max(F.when(F.col("col") == names[str(c)], F.col(f"q{qs.index(q)}"))).alias(n)
             for n, (c, q) in wanted.items()]
    flat = table.groupBy(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)]).agg(*picks)
    if not by:
        row = flat.first()
        return out.select("*", *[F.lit(row[n]).cast("double").alias(n) for n in wanted])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    return out.join(flat, same, "left").drop(*[f"__b{i}" for i in range(len(by))])
