"""Fold-train statistics applied per model fold.

For model fold ``f`` the statistics come from labelled rows with ``fold != f``.
Medians: exact distributed order statistics, all ``k`` folds and all columns in one
pass (``functions.quantiles``), computed only for columns that contain nulls. Means and standard deviations: one ``groupBy(fold)``
of per-fold moments, merged on the driver (Chan's pairwise formula) for each
fold-train set. The data is read once per statistic family, never ``k`` times;
the ``k x columns`` parameters are applied as literals (or a one-row join).

``design_by_fold`` emits the per-model-fold view a fold model consumes: every row
once per model fold with role ``train`` / ``valid`` / ``test`` (k rows per input
row, bounded by k).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import quantiles as Q
from foldspark.operators.joins import attach_scalar_row


def fold_medians(df: DataFrame, cols: Sequence[str], k: int, fold_col: str = "fold",
                 train_col: str = "is_train") -> DataFrame:
    """One row: ``med_<c>_<f>`` = median of ``c`` over labelled rows outside fold f.

    One pass carries k counts per value ("all folds but f"); see ``functions.quantiles``."""
    t = Q.column_quantiles(df.where(F.col(train_col)), {c: F.col(c) for c in cols},
                           weights=[(F.col(fold_col) != f).cast("int") for f in range(k)])
    got = {(r["col"], r["variant"]): r["q0"] for r in t.collect()}      # columns x k rows
    names = [(c, f) for c in cols for f in range(k)]
    return df.sparkSession.createDataFrame([tuple(got.get(n) for n in names)],
                                           ", ".join(f"`med_{c}_{f}` double" for c, f in names))


def null_columns_and_rows(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], int]:
    """Columns holding at least one null, and the row count (one aggregate)."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > 0], int(row["__n"])


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that hold at least one null (one aggregate of ``len(cols)`` counts).
    The source fills only such columns; medians of the others are never used."""
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > 0]


def _pick(prefix: str, c: str, k: int, fold: Column) -> Column:
    return F.element_at(F.array(*[F.col(f"{prefix}_{c}_{f}") for f in range(k)]), fold + 1)


def design_by_fold(df: DataFrame, k: int, fold_col: str = "fold", train_col: str = "is_train",
                   out: str = "model_fold") -> DataFrame:
    """Every row once per model fold, with its role in that fold's model."""
    x = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(out))
    role = (F.when(~F.col(train_col), F.lit("test"))
             .when(F.col(fold_col) == F.col(out), F.lit("valid")).otherwise(F.lit("train")))
    return x.withColumn("role", role)


def fold_median_fill(df: DataFrame, cols: Sequence[str], k: int = 5, fold_col: str = "fold",
                     train_col: str = "is_train") -> DataFrame:
    """P10: per model fold, nulls filled with the fold-train median (only columns
    that contain nulls need medians)."""
    need = columns_with_nulls(df, cols)
    x = design_by_fold(attach_scalar_row(df, fold_medians(df, need, k, fold_col, train_col))
                       if need else df, k, fold_col, train_col)
    mf = F.col("model_fold")
    x = x.select(*[F.coalesce(F.col(c).cast("double"), _pick("med", c, k, mf)).alias(c) if c in need
                   else (F.col(c).cast("double").alias(c) if c in cols else F.col(c)) for c in x.columns])
    return x.drop(*[f"med_{c}_{f}" for c in need for f in range(k)])


def merge_moments(a, b):
    """Chan et al. pairwise merge of ``(n, mean, M2)`` summaries (numerically stable)."""
    na, ma, qa = a
    nb, mb, qb = b
    n = na + nb
    if n == 0:
        return (0, 0.0, 0.0)
    d = mb - ma
    return (n, ma + d * nb / n, qa + qb + d * d * na * nb / n)


def fold_train_moments(df: DataFrame, cols: Sequence[str], k: int, meds: dict, fold_col: str = "fold",
                       train_col: str = "is_train", label: str | None = None) -> dict:
    """Mean and population std of each median-filled column over the labelled rows
    outside fold f, for every f (and the label's sample std / count when given).

    One ``groupBy(fold)`` returns per-fold (count, mean, M2, nulls) of the
    observed values (k rows). The summary for fold f merges the other folds and
    the nulls filled with fold f's median (a group at the median with M2 = 0)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    if label is not None:
        aggs += [F.avg(label).alias("__my"), (F.var_pop(label) * F.count(label)).alias("__qy")]
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"m_{c}"), (F.var_pop(v) * F.count(v)).alias(f"q_{c}")]
    rows = {r["__fold"]: r.asDict() for r in
            df.where(F.col(train_col)).groupBy(F.col(fold_col).cast("int").alias("__fold")).agg(*aggs).collect()}
    out = {}
    for f in range(k):
        others = [r for g, r in rows.items() if g != f]
        mu, sd = {}, {}
        for c in cols:
            acc, nulls = (0, 0.0, 0.0), 0
            for r in others:
                acc = merge_moments(acc, (r[f"n_{c}"], r[f"m_{c}"] or 0.0, r[f"q_{c}"] or 0.0))
                nulls += r["__rows"] - r[f"n_{c}"]
            med = meds.get(f"med_{c}_{f}")
            if nulls and med is not None:
                acc = merge_moments(acc, (nulls, float(med), 0.0))
            mu[c] = acc[1] if acc[0] else None
            sd[c] = math.sqrt(max(acc[2], 0.0) / acc[0]) if acc[0] else None
        entry = {"mu": mu, "sd": sd, "n": sum(r["__rows"] for r in others)}
        if label is not None:
            y = (0, 0.0, 0.0)
            for r in others:
                y = merge_moments(y, (r["__rows"], r["__my"] or 0.0, r["__qy"] or 0.0))
            entry["sdy"] = math.sqrt(max(y[2], 0.0) / (y[0] - 1)) if y[0] > 1 else None
        out[f] = entry
    return out


def fold_standardize(df: DataFrame, cols: Sequence[str], k: int = 5, fold_col: str = "fold",
                     train_col: str = "is_train") -> DataFrame:
    """P10 then P11: fill with fold-train medians, then scale with the fold-train
    mean and population std of the filled values (std 0 -> scale 1). Statistics:
    one filtered-median aggregate (columns with nulls only) and one ``groupBy(fold)``;
    the per-fold parameters (k x columns numbers) are applied as literals."""
    need = columns_with_nulls(df, cols)
    meds = fold_medians(df, need, k, fold_col, train_col).first().asDict() if need else {}
    mom = fold_train_moments(df, cols, k, meds, fold_col, train_col)
    x = design_by_fold(df, k, fold_col, train_col)
    mf = F.col("model_fold")

    def per_fold(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), mf + 1)

    sel = []
    for c in x.columns:
        if c in cols:
            v = F.col(c).cast("double")
            filled = F.coalesce(v, per_fold([meds.get(f"med_{c}_{f}") for f in range(k)])) if c in need else v
            scale = [mom[f]["sd"][c] if mom[f]["sd"][c] else 1.0 for f in range(k)]
            sel.append(((filled - per_fold([mom[f]["mu"][c] for f in range(k)])) / per_fold(scale)).alias(c))
        else:
            sel.append(F.col(c))
    return x.select(*sel)
