"""Queries for fold-safe fills, scores and error analysis (survey step 3)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import folds, foldstats, metrics as M
from foldspark.plans import fixtures as FX
from foldspark.plans.catalog import fold_sql, query
from foldspark.plans.q_prep import P_CTE, cleaned_panel, round_doubles

MODELS = ["p_a", "p_b", "p_c"]


def model_preds(spark: SparkSession, sf: str, train_only: bool = True) -> DataFrame:
    """``(id, is_train, target, fold, model, pred)`` from the three prediction columns."""
    p = folds.hash_folds(FX.preds(spark, sf), 5, 42)
    if train_only:
        p = p.where("is_train")
    return p.select("id", "is_train", "target", "fold",
                    F.expr("stack(3, 'p_a', p_a, 'p_b', p_b, 'p_c', p_c) as (model, pred)"))


def preds_with_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Model ``p_a`` predictions of train rows next to the cleaned panel columns."""
    pr = FX.preds(spark, sf).where("is_train").select("id", F.col("p_a").alias("pred"))
    return cleaned_panel(spark, sf).where("is_train").join(pr, "id")


Q_CTE = (FX.oracle_ctes(with_preds=True)
         + ", p as (select * replace (case country when 'NATION_1_ALT' then 'NATION_1' "
           "when 'NATION_2_ALT' then 'NATION_2' else country end as country) from panel)\n"
         + f", pl as (select id, is_train, target, {fold_sql()}::int as fold, model, pred from preds "
           "unpivot (pred for model in (p_a, p_b, p_c)) where is_train)\n"
         + ", pp as (select p.*, preds.p_a as pred from p join preds on p.id = preds.id where p.is_train)\n")

# ---- P10 / P11 --------------------------------------------------------------------

FILL_COLS = ["age", "bmi", "caffeine_mg", "stress", "rem_pct", "latency_min", "steps"]

_DESIGN_SQL = (P_CTE + f", d as (select p.*, case when is_train then {fold_sql()} end as fold, mf.model_fold, "
               "case when not is_train then 'test' when " + fold_sql() + " = mf.model_fold then 'valid' "
               "else 'train' end as role from p, range(5) mf(model_fold))\n"
               ", med as (select model_fold, " + ", ".join(f"median({c}) as m_{c}" for c in FILL_COLS)
               + " from d where role = 'train' group by model_fold)\n"
               ", filled as (select d.id, d.model_fold, d.role, " + ", ".join(
                   f"coalesce({c}, m_{c}) as {c}" for c in FILL_COLS)
               + " from d join med on d.model_fold = med.model_fold)\n")


@query("fold_median_fill", _DESIGN_SQL + "select id, model_fold, role, " + ", ".join(
    f"round({c}, 8) as {c}" for c in FILL_COLS) + " from filled", "P10")
def q_fold_median_fill(spark, sf):
    """P10: each row once per model fold, nulls filled with that fold's train median."""
    p = folds.hash_folds(cleaned_panel(spark, sf), 5, 42)
    p = p.withColumn("fold", F.when(F.col("is_train"), F.col("fold")))
    out = foldstats.fold_median_fill(p, FILL_COLS, 5)
    return round_doubles(out.select("id", F.col("model_fold").cast("int").alias("model_fold"), "role", *FILL_COLS))


@query("fold_standardize", _DESIGN_SQL + ", mom as (select model_fold, " + ", ".join(
    f"avg({c}) as mu_{c}, stddev_pop({c}) as sd_{c}" for c in FILL_COLS)
    + " from filled where role = 'train' group by model_fold)\nselect id, f.model_fold, role, " + ", ".join(
    f"round(({c} - mu_{c}) / (case when sd_{c} = 0 then 1 else sd_{c} end), 6) as {c}" for c in FILL_COLS)
    + " from filled f join mom on f.model_fold = mom.model_fold", "P10, P11")
def q_fold_standardize(spark, sf):
    """P10 + P11: fold-train median fill, then fold-train mean / population-std scaling."""
    p = folds.hash_folds(cleaned_panel(spark, sf), 5, 42)
    p = p.withColumn("fold", F.when(F.col("is_train"), F.col("fold")))
    out = foldstats.fold_standardize(p, FILL_COLS, 5)
    return round_doubles(out.select("id", F.col("model_fold").cast("int").alias("model_fold"), "role",
                                    *FILL_COLS), 6)


# ---- scores ------------------------------------------------------------------------

@query("rmse_by_model", Q_CTE + "select model, round(sqrt(avg((target - pred) * (target - pred))), 6) as rmse, "
       "count(*) as n from pl group by model", "G3")
def q_rmse_by_model(spark, sf):
    """OOF RMSE per model on labelled rows."""
    return round_doubles(M.rmse(model_preds(spark, sf), by=["model"]), 6)


@query("fold_scores", Q_CTE + ", f as (select model, fold, sum((target - pred) * (target - pred)) as sse, "
       "count(*) as n from pl group by model, fold)\n"
       "select model, round(sqrt(sum(sse) / sum(n)), 6) as cv_rmse, round(avg(sqrt(sse / n)), 6) as mean_fold_rmse, "
       "round(stddev_pop(sqrt(sse / n)), 6) as cv_std, count(*) as n_folds from f group by model", "G4, M11")
def q_fold_scores(spark, sf):
    """RMSE per fold, mean and population std over folds, pooled OOF RMSE."""
    fs = M.fold_scores(model_preds(spark, sf), by=["model"]).drop("fold_scores")
    return round_doubles(fs, 6)


@query("r2_by_model", Q_CTE + "select model, round(1 - sum((target - pred) * (target - pred)) / "
       "(count(*) * var_pop(target)), 6) as r2 from pl group by model", "G5")
def q_r2_by_model(spark, sf):
    """Coefficient of determination per model."""
    return round_doubles(M.r2(model_preds(spark, sf), by=["model"]), 6)


@query("error_summary", Q_CTE + "select model, round(sqrt(avg((target - pred) * (target - pred))), 6) as rmse, "
       "round(avg(abs(target - pred)), 6) as mae, round(median(abs(target - pred)), 6) as median_abs, "
       "round(max(abs(target - pred)), 6) as max_abs, round(stddev_pop(target - pred), 6) as std_err, "
       "round(avg(target - pred), 6) as bias, count(*) filter (where abs(target - pred) > 2) as n_big, "
       "round(avg((abs(target - pred) > 2)::int), 6) as share_big, count(*) as n from pl group by model",
       "G6, P15")
def q_error_summary(spark, sf):
    """G6 + P15: error summary and count/share of |e| > 2 per model."""
    return round_doubles(M.error_summary(model_preds(spark, sf), by=["model"]), 6)


@query("error_quantiles", Q_CTE + "select model, " + ", ".join(
    f"round(quantile_cont(abs(target - pred), {q}), 6) as q{int(round(q * 100))}" for q in M.ABS_ERROR_QUANTILES)
    + " from pl group by model", "G7")
def q_error_quantiles(spark, sf):
    """Quantiles .5 .75 .9 .95 .99 of |e| (linear interpolation) per model."""
    return round_doubles(M.error_quantiles(model_preds(spark, sf), by=["model"]), 6)


_BIN_SQL = ("case " + " ".join(
    (f"when target >= {lo} and target <= {hi} then {i}" if i == 0 else f"when target > {lo} and target <= {hi} then {i}")
    for i, (lo, hi) in enumerate(zip(M.TARGET_BIN_EDGES[:-1], M.TARGET_BIN_EDGES[1:]))) + " end")
_LO_SQL = "[" + ", ".join(f"{float(v)}" for v in M.TARGET_BIN_EDGES[:-1]) + "]"
_HI_SQL = "[" + ", ".join(f"{float(v)}" for v in M.TARGET_BIN_EDGES[1:]) + "]"


@query("error_by_target_bin", Q_CTE + f", b as (select model, {_BIN_SQL} as bin, target - pred as e from pl)\n"
       "select model, bin, round(avg(abs(e)), 6) as mae, round(median(abs(e)), 6) as median_abs, count(*) as n, "
       "round(avg(e), 6) as bias, round(median(e), 6) as median_err, "
       f"{_LO_SQL}[bin + 1] as lo, {_HI_SQL}[bin + 1] as hi from b where bin is not null group by model, bin",
       "G8")
def q_error_by_target_bin(spark, sf):
    """|e| mean/median/count and e mean/median per target bin [0,2],(2,4],...,(8,10]."""
    return round_doubles(M.error_by_target_bin(model_preds(spark, sf), by=["model"]), 6)


_CAT_SQL_LONG = " union all ".join(f"select '{c}' as col, {c} as level, abs(target - pred) as a from pp"
                                   for c in FX.PANEL_CATEGORIES)


@query("error_by_category", Q_CTE + f", lg as ({_CAT_SQL_LONG})\n"
       ", per as (select col, level, avg(a) as mean_abs, count(*) as n from lg where level is not null group by all)\n"
       ", sp as (select col, max(mean_abs) - min(mean_abs) as spread, count(*) as n_levels from per group by col)\n"
       "select per.col, level, round(mean_abs, 6) as mean_abs, n, round(spread, 6) as spread, n_levels "
       "from per join sp on per.col = sp.col where n_levels > 1 and spread > 0.05", "G9, P17, T2")
def q_error_by_category(spark, sf):
    """G9 + P17 + T2: mean |e| per category level where the column's spread exceeds 0.05."""
    return round_doubles(M.error_by_category(preds_with_panel(spark, sf), FX.PANEL_CATEGORIES), 6)


@query("error_by_missing", Q_CTE + ", lg as (" + " union all ".join(
    f"select '{c}' as col, {c} is null as miss, abs(target - pred) as a from pp" for c in FX.PANEL_MISSING)
    + ")\nselect col, round(avg(a) filter (where miss), 6) as mae_missing, round(avg(a) filter (where not miss), 6) "
    "as mae_present, count(*) filter (where miss) as n_missing, "
    "round(avg(a) filter (where miss) - avg(a) filter (where not miss), 6) as diff from lg group by col "
    "having count(*) filter (where miss) > 0", "G10, P16")
def q_error_by_missing(spark, sf):
    """G10 + P16: mean |e| for missing vs present values of six columns."""
    return round_doubles(M.error_by_missing(preds_with_panel(spark, sf), FX.PANEL_MISSING), 6)


@query("bias_profile", Q_CTE + f"select model as method, {_BIN_SQL} as bin, round(avg(target - pred), 6) as bias, "
       "count(*) as n from pl where bin is not null group by all", "G11")
def q_bias_profile(spark, sf):
    """Mean error per (method, target bin)."""
    x = model_preds(spark, sf).withColumnRenamed("model", "method")
    return round_doubles(M.bias_profile(x), 6)


@query("worst_n", Q_CTE + "select id, round(abs(target - pred), 8) as abs_err from pp "
       "order by abs(target - pred) desc, id limit 200", "T1")
def q_worst_n(spark, sf):
    """The 200 largest absolute errors of model p_a (top-k report)."""
    return round_doubles(M.worst_n(preds_with_panel(spark, sf), 200).select("id", "abs_err"))


_NUM = FX.PANEL_NUMERIC


@query("worst_vs_all", Q_CTE + ", w as (select * from pp order by abs(target - pred) desc, id limit 200)\n"
       ", a as (" + " union all ".join(f"select '{c}' as col, avg({c}) as mean_all from pp" for c in _NUM) + ")\n"
       ", b as (" + " union all ".join(f"select '{c}' as col, avg({c}) as mean_worst from w" for c in _NUM) + ")\n"
       ", d as (select a.col, mean_all, mean_worst, 100 * (mean_worst - mean_all) / (abs(mean_all) + 1e-6) as diff_pct "
       "from a join b on a.col = b.col)\n"
       "select col, round(mean_all, 6) as mean_all, round(mean_worst, 6) as mean_worst, round(diff_pct, 6) as diff_pct "
       "from d where abs(diff_pct) > 5", "G12")
def q_worst_vs_all(spark, sf):
    """Feature means of the 200 worst rows vs all rows, where they differ by more than 5 %."""
    return round_doubles(M.worst_vs_all(preds_with_panel(spark, sf), _NUM, 200), 6)


@query("error_histogram", Q_CTE + ", x as (select target - pred as v from pp), mm as (select min(v) as vmin, "
       "max(v) as vmax from x)\n, b as (select least(floor((v - vmin) / (vmax - vmin) * 80), 79)::int as bin, "
       "vmin, vmax from x, mm)\nselect bin, count(*) as n, round(min(vmin) + (min(vmax) - min(vmin)) * bin / 80, 6) as lo, "
       "round(min(vmin) + (min(vmax) - min(vmin)) * (bin + 1) / 80, 6) as hi from b group by bin", "G13")
def q_error_histogram(spark, sf):
    """Histogram of the error of p_a in 80 equal-width bins."""
    x = preds_with_panel(spark, sf)
    return round_doubles(M.histogram(x, M.err()), 6)


@query("error_box", Q_CTE + f", x as (select {_BIN_SQL} as grp, abs(target - pred) as v from pp)\n"
       ", q as (select grp, count(*) as n, quantile_cont(v, 0.25) as q1, median(v) as med, quantile_cont(v, 0.75) as q3 "
       "from x where grp is not null group by grp)\n"
       ", w as (select x.grp, min(v) filter (where v >= q1 - 1.5 * (q3 - q1)) as lo_in, "
       "max(v) filter (where v <= q3 + 1.5 * (q3 - q1)) as hi_in from x join q on x.grp = q.grp group by x.grp)\n"
       "select q.grp, n, round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3, "
       "round(case when lo_in is null or lo_in > q1 then q1 else lo_in end, 6) as whislo, "
       "round(case when hi_in is null or hi_in < q3 then q3 else hi_in end, 6) as whishi from q join w on q.grp = w.grp",
       "G14")
def q_error_box(spark, sf):
    """Box statistics (quartiles, 1.5-IQR whiskers) of |e| per target bin."""
    x = preds_with_panel(spark, sf)
    return round_doubles(M.box_stats(x, M.target_bin(), F.abs(M.err())), 6)


_ALL_COLS = [c for c in ["is_train", *FX.PANEL_NUMERIC, *FX.PANEL_CATEGORIES, "target"]]


@query("null_profile", P_CTE + " union all ".join(
    f"select '{c}' as col, count(*) filter (where {c} is null) as n_null, count(*) as n from p" for c in _ALL_COLS),
    "G16")
def q_null_profile(spark, sf):
    """Null count of every panel column."""
    return M.null_profile(cleaned_panel(spark, sf), _ALL_COLS)


@query("level_counts", P_CTE + " union all ".join(
    f"select is_train, '{c}' as col, count(distinct {c}) as n_distinct from p group by is_train"
    for c in FX.PANEL_CATEGORIES), "G15")
def q_level_counts(spark, sf):
    """Distinct levels of each category column per split."""
    return M.level_counts(cleaned_panel(spark, sf), FX.PANEL_CATEGORIES, by=["is_train"])


@query("rounding_noise", P_CTE + "select round(sqrt(avg((target - round_even(target, 0)) * (target - round_even(target, 0)))), 6) "
       "as round_rmse, count(*) as n from p where is_train", "G20")
def q_rounding_noise(spark, sf):
    """RMSE of the labelled target to its nearest integer."""
    return round_doubles(M.rounding_noise(cleaned_panel(spark, sf).where("is_train")), 6)


@query("fraction_profile", P_CTE + ", x as (select greatest(0, least(10, round_even(target, 0)))::int as cls, "
       "target - floor(target) as frac from p where is_train)\n"
       "select cls, least(floor(frac * 10), 9)::int as frac_bin, count(*) as n, round(min(frac), 6) as frac_min, "
       "round(max(frac), 6) as frac_max from x group by all", "G21, F45")
def q_fraction_profile(spark, sf):
    """Fractional part of the target in 10 bins per integer class."""
    return round_doubles(M.fraction_profile(cleaned_panel(spark, sf).where("is_train")), 6)


@query("target_moments", P_CTE + "select count(target) as n, round(avg(target), 6) as mean, round(stddev_samp(target), 6) "
       "as std, round(stddev_pop(target), 6) as std_pop, round(min(target), 6) as min, round(max(target), 6) as max, "
       "round(skewness(target), 6) as skew from p where is_train", "G2")
def q_target_moments(spark, sf):
    """Count, mean, std (sample and population), min, max and bias-corrected skew of the target."""
    return round_doubles(M.target_moments(cleaned_panel(spark, sf).where("is_train")), 6)
