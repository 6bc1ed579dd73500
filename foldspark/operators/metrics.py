"""Scores and error analysis.

Every report is one or two aggregates. Repeated per-column reports stack the
columns into long form once and run a single ``groupBy`` (one scan instead of
one per column). Quantiles follow numpy's linear rule and are exact at every size
(``functions.quantiles``: distributed order statistics, no value map in one task).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import exprs as X
from foldspark.functions import quantiles as Q
from foldspark.operators.joins import attach, attach_scalar_row

# Fixed values of the source's error analysis.
TARGET_BIN_EDGES = [0, 2, 4, 5, 6, 8, 10]
ABS_ERROR_QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
BIG_ERROR = 2.0


def err(y: str = "target", p: str = "pred") -> Column:
    return F.col(y).cast("double") - F.col(p).cast("double")


def rmse_expr(y: str = "target", p: str = "pred") -> Column:
    e = err(y, p)
    return F.sqrt(F.avg(e * e))


def rmse(df: DataFrame, y: str = "target", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """G3."""
    return df.groupBy(*by).agg(rmse_expr(y, p).alias("rmse"), F.count(F.lit(1)).alias("n"))


def fold_scores(df: DataFrame, y: str = "target", p: str = "pred", fold: str = "fold",
                by: Sequence[str] = ()) -> DataFrame:
    """RMSE per fold; mean and population std over folds; pooled OOF RMSE."""
    e = err(y, p)
    per = df.groupBy(*by, fold).agg(F.sum(e * e).alias("sse"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("fold_rmse", F.sqrt(F.col("sse") / F.col("n")))
    return per.groupBy(*by).agg(
        F.sqrt(F.sum("sse") / F.sum("n")).alias("cv_rmse"),
        F.avg("fold_rmse").alias("mean_fold_rmse"),
        F.stddev_pop("fold_rmse").alias("cv_std"),
        F.sort_array(F.collect_list(F.struct(F.col(fold), F.col("fold_rmse")))).alias("fold_scores"),
        F.count(F.lit(1)).alias("n_folds"))


def r2(df: DataFrame, y: str = "target", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / (n * var_pop(y)); null for a constant target."""
    e = err(y, p)
    return df.groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(F.col(y)))).alias("r2"))


def error_summary(df: DataFrame, y: str = "target", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """G6 + P15: RMSE, MAE, median/max |e|, population std of e, bias, big-error count/share."""
    e = err(y, p)
    a = F.abs(e)
    return Q.with_quantiles(df, by, [
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(a).alias("mae"),
        F.max(a).alias("max_abs"), F.stddev_pop(e).alias("std_err"), F.avg(e).alias("bias"),
        F.count_if(a > BIG_ERROR).alias("n_big"), F.avg((a > BIG_ERROR).cast("double")).alias("share_big"),
        F.count(F.lit(1)).alias("n")], {"median_abs": (a, 0.5)})


def error_quantiles(df: DataFrame, y: str = "target", p: str = "pred", qs=ABS_ERROR_QUANTILES,
                    by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of |e|, one column per quantile."""
    a = F.abs(err(y, p))
    x = df.select(*by, a.alias("__a"))
    t = Q.quantiles(x, list(by), "__a", qs)
    return t.select(*by, *[F.col(f"q{i}").alias(f"q{int(round(q * 100))}") for i, q in enumerate(qs)])


def target_bin(y: str = "target", edges=TARGET_BIN_EDGES) -> Column:
    """``pd.cut(include_lowest=True)``: right-closed bins, first bin closed on both sides."""
    return X.right_closed_bins(y, edges, include_lowest=True)


def error_by_target_bin(df: DataFrame, y: str = "target", p: str = "pred", edges=TARGET_BIN_EDGES,
                        by: Sequence[str] = ()) -> DataFrame:
    """|e| mean/median/count and e mean/median per target bin (empty bins absent)."""
    e = err(y, p)
    x = df.select(*by, target_bin(y, edges).alias("bin"), e.alias("e"))
    lo = F.element_at(F.array(*[F.lit(float(v)) for v in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(v)) for v in edges[1:]]), F.col("bin") + 1)
    return Q.with_quantiles(x.where(F.col("bin").isNotNull()), [*by, "bin"], [
        F.avg(F.abs("e")).alias("mae"), F.count(F.lit(1)).alias("n"), F.avg("e").alias("bias")],
        {"median_abs": (F.abs("e"), 0.5), "median_err": (F.col("e"), 0.5)}).withColumn("lo", lo).withColumn("hi", hi)


def _stack(df: DataFrame, cols: Sequence[str], keep: Sequence[str], as_string: bool = True) -> DataFrame:
    """Long form ``(keep..., col, level)`` of several columns (one generator, no union)."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col"),
                                      (F.col(c).cast("string") if as_string else F.col(c).cast("double")).alias("level"))
                             for c in cols]))
    return df.select(*keep, kv.alias("kv")).select(*keep, "kv.col", "kv.level")


def error_by_category(df: DataFrame, cat_cols: Sequence[str], y: str = "target", p: str = "pred",
                      min_spread: float = 0.05) -> DataFrame:
    """G9 + P17 + T2: mean |e| and count per level; columns with >= 2 levels and
    spread (max - min of level means) above ``min_spread``; sorted by mean within column."""
    x = _stack(df.withColumn("__a", F.abs(err(y, p))), cat_cols, ["__a"])
    per = (x.where(F.col("level").isNotNull()).groupBy("col", "level")
            .agg(F.avg("__a").alias("mean_abs"), F.count(F.lit(1)).alias("n")))
    spread = per.groupBy("col").agg((F.max("mean_abs") - F.min("mean_abs")).alias("spread"),
                                    F.count(F.lit(1)).alias("n_levels"))
    keep = spread.where((F.col("n_levels") > 1) & (F.col("spread") > min_spread))
    # one row per analysed column: bounded by len(cat_cols)
    return (per.join(F.broadcast(keep), "col").orderBy("col", F.desc("mean_abs")))


def error_by_missing(df: DataFrame, cols: Sequence[str], y: str = "target", p: str = "pred") -> DataFrame:
    """G10 + P16: mean |e| of rows where the column is null vs not; columns without nulls skipped."""
    a = F.abs(err(y, p))
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).isNull().alias("miss")) for c in cols]))
    x = df.select(a.alias("a"), kv.alias("kv")).select("a", "kv.col", "kv.miss")
    out = x.groupBy("col").agg(
        F.avg(F.when(F.col("miss"), F.col("a"))).alias("mae_missing"),
        F.avg(F.when(~F.col("miss"), F.col("a"))).alias("mae_present"),
        F.count_if(F.col("miss")).alias("n_missing"))
    return (out.where(F.col("n_missing") > 0)
               .withColumn("diff", F.col("mae_missing") - F.col("mae_present")))


def bias_profile(df: DataFrame, method: str = "method", y: str = "target", p: str = "pred",
                 edges=TARGET_BIN_EDGES) -> DataFrame:
    """Mean error per (method, target bin)."""
    return (df.select(method, target_bin(y, edges).alias("bin"), err(y, p).alias("e"))
              .where(F.col("bin").isNotNull())
              .groupBy(method, "bin").agg(F.avg("e").alias("bias"), F.count(F.lit(1)).alias("n")))


def worst_n(df: DataFrame, n: int = 200, y: str = "target", p: str = "pred", id_col: str = "id") -> DataFrame:
    """The n largest |e| (ties by id); a top-n, each task keeps n rows."""
    return (df.withColumn("abs_err", F.abs(err(y, p)))
              .orderBy(F.desc("abs_err"), F.col(id_col)).limit(n))


def worst_vs_all(df: DataFrame, features: Sequence[str], n: int = 200, y: str = "target",
                 p: str = "pred", id_col: str = "id", min_pct: float = 5.0) -> DataFrame:
    """Mean of each feature over all rows vs the worst n; keep |diff %| > min_pct."""
    worst = worst_n(df, n, y, p, id_col)
    a = _stack(df, features, [], as_string=False).groupBy("col").agg(F.avg("level").alias("mean_all"))
    w = _stack(worst, features, [], as_string=False).groupBy("col").agg(F.avg("level").alias("mean_worst"))
    out = a.join(w, "col").withColumn(
        "diff_pct", F.lit(100.0) * (F.col("mean_worst") - F.col("mean_all")) / (F.abs("mean_all") + F.lit(1e-6)))
    return out.where(F.abs("diff_pct") > min_pct)


def histogram(df: DataFrame, value: Column, bins: int = 80) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (numpy rule)."""
    x = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    mm = x.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    x = attach_scalar_row(x, mm)
    width = (F.col("vmax") - F.col("vmin"))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("vmin")) / width * F.lit(bins)), F.lit(bins - 1))).cast("int")
    return (x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("vmin").alias("vmin"),
                                          F.first("vmax").alias("vmax"))
             .select("bin", "n", (F.col("vmin") + (F.col("vmax") - F.col("vmin")) * F.col("bin") / bins).alias("lo"),
                     (F.col("vmin") + (F.col("vmax") - F.col("vmin")) * (F.col("bin") + 1) / bins).alias("hi")))


def box_stats(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 IQR; fall back to the quartile)."""
    x = df.select(group.alias("grp"), value.cast("double").alias("v")).where(
        F.col("grp").isNotNull() & F.col("v").isNotNull())
    q = Q.quantiles(x, ["grp"], "v", [0.25, 0.5, 0.75]).toDF("grp", "variant", "q1", "med", "q3").drop("variant")
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = attach(x, q, on="grp")                      # one row per group, size-checked
    out = j.groupBy("grp").agg(
        F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("lo_in"),
        F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("hi_in"),
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("q1", "med", "q3")])
    return out.select("grp", "n", "q1", "med", "q3",
                      F.when(F.col("lo_in").isNull() | (F.col("lo_in") > F.col("q1")), F.col("q1"))
                       .otherwise(F.col("lo_in")).alias("whislo"),
                      F.when(F.col("hi_in").isNull() | (F.col("hi_in") < F.col("q3")), F.col("q3"))
                       .otherwise(F.col("hi_in")).alias("whishi"))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per column (one aggregate, then unpivot of one row)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
                 F.count(F.lit(1)).alias("__n"))
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n_null")) for c in cols]))
    return one.select(kv.alias("kv"), "__n").select("kv.col", "kv.n_null", F.col("__n").alias("n"))


def level_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Distinct non-null values per column (``approx_count_distinct`` when not exact)."""
    x = _stack(df, cols, list(by))
    agg = F.countDistinct("level") if exact else F.approx_count_distinct("level")
    return x.groupBy(*by, "col").agg(agg.alias("n_distinct"))


def target_moments(df: DataFrame, y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample/population std, min, max, skew (bias-corrected, as pandas)."""
    v = F.col(y).cast("double")
    n = F.count(v)
    g1 = F.skewness(v)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2).alias("skew"))


def rounding_noise(df: DataFrame, y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """RMSE of the target to its nearest integer (half to even)."""
    e = F.col(y) - F.bround(F.col(y), 0)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("round_rmse"), F.count(F.lit(1)).alias("n"))


def fraction_profile(df: DataFrame, y: str = "target", bins: int = 10) -> DataFrame:
    """Histogram of the fractional part of the target per integer class."""
    frac = F.col(y) - F.floor(F.col(y))
    return (df.select(X.int_class(y).alias("cls"), frac.alias("frac"))
              .groupBy("cls", F.least(F.floor(F.col("frac") * bins), F.lit(bins - 1)).cast("int").alias("frac_bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("frac").alias("frac_min"), F.max("frac").alias("frac_max")))
