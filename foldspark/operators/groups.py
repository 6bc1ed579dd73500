"""Group statistics of feature columns.

Mean and sample std of each aggregate column per level of each group column,
computed from labelled rows and attached to all rows, plus the deviation
``x - group mean``. All group columns are stacked into one long aggregate (one
scan, partial aggregation before the shuffle), giving a table with one row per
(group column, level). It is joined back after a size check, so wide rows are
not shuffled. Null levels form no group (their statistics stay null).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.joins import checked_small, left_lookup

DEFAULT_GROUP_COLS = ["country", "occupation", "chronotype"]
DEFAULT_AGG_COLS = ["age", "stress", "work_hours", "rem_pct", "bmi"]


def stats_name(g: str, a: str, stat: str) -> str:
    return f"fe_grp_{g}_{a}_{stat}"


def group_stats(df: DataFrame, group_cols: Sequence[str] = DEFAULT_GROUP_COLS,
                agg_cols: Sequence[str] = DEFAULT_AGG_COLS, train_col: str | None = "is_train") -> DataFrame:
    """Long table ``(group_col, level, <a>_mean, <a>_std, <a>_n ...)``."""
    src = df.where(F.col(train_col)) if train_col else df
    long = src.select(*[F.col(a).cast("double").alias(a) for a in agg_cols],
                      F.explode(F.array(*[F.struct(F.lit(g).alias("group_col"),
                                                   F.col(g).cast("string").alias("level"))
                                          for g in group_cols])).alias("kv"))
    aggs = []
    for a in agg_cols:
        aggs += [F.avg(a).alias(f"{a}_mean"), F.stddev_samp(a).alias(f"{a}_std"),
                 F.count(a).alias(f"{a}_n")]
    return (long.where(F.col("kv.level").isNotNull())
                .groupBy(F.col("kv.group_col").alias("group_col"), F.col("kv.level").alias("level"))
                .agg(*aggs))


def apply_group_statistics(df: DataFrame, stats: DataFrame, small: bool,
                           group_cols: Sequence[str], agg_cols: Sequence[str]) -> DataFrame:
    """Join the fitted statistics per group column and add the deviations
    (broadcast when ``small``)."""
    out, added = df, []
    for g in group_cols:
        t = stats.where(F.col("group_col") == g).select("level", *[
            F.col(f"{a}_{st}").alias(stats_name(g, a, st)) for a in agg_cols for st in ("mean", "std")])
        out = left_lookup(out, [F.col(g).cast("string")], t, ["level"], small)
        for a in agg_cols:
            added += [F.col(stats_name(g, a, "mean")), F.col(stats_name(g, a, "std")),
                      (F.col(a) - F.col(stats_name(g, a, "mean"))).alias(stats_name(g, a, "dev"))]
    return out.select(*[F.col(c) for c in df.columns], *added)


def fit_group_statistics(df: DataFrame, group_cols: Sequence[str] = DEFAULT_GROUP_COLS,
                         agg_cols: Sequence[str] = DEFAULT_AGG_COLS, train_col: str | None = "is_train"):
    """Fitted statistics: ``(stored table, passed broadcast size check)``."""
    return checked_small(group_stats(df, group_cols, agg_cols, train_col))


def add_group_statistics(df: DataFrame, group_cols: Sequence[str] = DEFAULT_GROUP_COLS,
                         agg_cols: Sequence[str] = DEFAULT_AGG_COLS,
                         train_col: str | None = "is_train") -> DataFrame:
    """G1: add ``fe_grp_<g>_<a>_{mean,std,dev}`` for every (g, a)."""
    group_cols = [g for g in group_cols if g in df.columns]
    agg_cols = [a for a in agg_cols if a in df.columns]
    stats, small = fit_group_statistics(df, group_cols, agg_cols, train_col)
    return apply_group_statistics(df, stats, small, group_cols, agg_cols)
