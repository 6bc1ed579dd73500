"""Cross-validation fold assignment.

Folds are a pure function of the row id and a seed, so every executor (and any
SQL engine with md5) assigns the same fold without coordination:
``h = first 32 bits of md5(id ':' seed)``.

* ``hash_folds``      fold = h % k (sizes differ by sampling noise)
* ``balanced_folds``  fold = (global rank of (h, id)) % k, sizes differ by <= 1;
                      with ``by`` the rank runs inside each class (stratified).

The global rank is computed without an unpartitioned window: rows are cut into
``n_buckets`` ranges of ``h`` (monotone in ``h``, so the order is kept), each
(class, bucket) ranks its own rows, and a prefix sum over the per-bucket counts
(``classes x n_buckets`` rows, not data rows) gives the offset of each bucket. A
hot class is spread over all buckets, so no task holds a whole class.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.exprs import seeded_key
from foldspark.operators.joins import attach

_HASH_BITS = 32


def hash_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "id",
               out: str = "fold") -> DataFrame:
    """K1."""
    return df.withColumn(out, (seeded_key(id_col, seed) % F.lit(k)).cast("int"))


def balanced_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "id",
                   by: str | None = None, out: str = "fold", bucket_bits: int = 14) -> DataFrame:
    """K1b (``by=None``) and K2 (``by=<class column>``)."""
    keys = [by] if by else []
    h = "__h"
    b = "__bucket"
    base = (df.withColumn(h, seeded_key(id_col, seed))
              .withColumn(b, F.shiftright(F.col(h), _HASH_BITS - bucket_bits)))
    counts = base.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    prefix = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum("__n").over(prefix), F.lit(0)).alias("__off"))
    rank_w = Window.partitionBy(*keys, b).orderBy(F.col(h), F.col(id_col))
    ranked = base.withColumn("__rn", F.row_number().over(rank_w))
    return (attach(ranked, offsets, on=keys + [b], how="left")
            .withColumn(out, ((F.col("__off") + F.col("__rn") - 1) % F.lit(k)).cast("int"))
            .drop(h, b, "__rn", "__off"))


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42,
                     id_col: str = "id", out: str = "fold") -> DataFrame:
    """K2."""
    return balanced_folds(df, k, seed, id_col, by=label, out=out)


def multi_seed_folds(df: DataFrame, seeds: Sequence[int], k: int = 5, id_col: str = "id",
                     out: str = "fold") -> DataFrame:
    """K3: one row per (row, seed) with that seed's hash fold."""
    seeds_col = F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")
    x = df.select("*", seeds_col)
    key = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"),
                                            F.col("seed").cast("string"))), 1, 8), 16, 10).cast("long")
    return x.withColumn(out, (key % F.lit(k)).cast("int"))


def fold_sizes(df: DataFrame, fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, fold_col).agg(F.count(F.lit(1)).alias("n"))
