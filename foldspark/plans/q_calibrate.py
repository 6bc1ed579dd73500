"""Queries for calibration and post-processing (survey step 5)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import blend as B
from foldspark.operators import calibrate as C
from foldspark.operators import folds, metrics as M
from foldspark.plans import fixtures as FX
from foldspark.plans.catalog import fold_sql, query
from foldspark.plans.q_prep import round_doubles
from foldspark.sources.scratch import stored

PR_CTE = FX.oracle_ctes(with_preds=True) + \
    f", pf as (select *, case when is_train then {fold_sql()} end as fold from preds)\n"


def calib_input(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions to correct: ``pred = p_a`` with hash folds on labelled rows."""
    p = folds.hash_folds(FX.preds(spark, sf), 5, 42)
    return p.withColumn("fold", F.when(F.col("is_train"), F.col("fold"))).withColumn("pred", F.col("p_a"))


@query("shrink_to_mean", PR_CTE + ", m as (select avg(p_a) as mu from preds where not is_train)\n"
       "select id, round(greatest(0, least(10, (p_a - mu) * 0.95 + mu)), 8) as pred from preds, m where not is_train",
       "C7")
def q_shrink_to_mean(spark, sf):
    """Test predictions pulled 5 % toward their mean, clipped."""
    t = calib_input(spark, sf).where(~F.col("is_train"))
    return round_doubles(B.shrink_to_mean(t, "pred", C.SHRINK).select("id", "pred"))


@query("soft_round", PR_CTE + "select id, round(greatest(0, least(10, p_a * (1 - 0.15) + round_even(p_a, 0) * 0.15)), 8) "
       "as pred from preds where not is_train", "C8")
def q_soft_round(spark, sf):
    """15 % pull toward the nearest integer (half to even), clipped."""
    t = calib_input(spark, sf).where(~F.col("is_train"))
    return round_doubles(B.soft_round(t, "pred", C.SOFT_ROUND_ALPHA).select("id", "pred"))


@query("pseudo_select", PR_CTE + "select count(*) filter (where p_a between 4 and 7) as n_selected, "
       "round(avg((p_a between 4 and 7)::int), 6) as share, round(avg(p_a) filter (where p_a between 4 and 7), 6) as mean_pred, "
       "round(stddev_pop(p_a) filter (where p_a between 4 and 7), 6) as std_pred, count(*) as n_unlabelled "
       "from preds where not is_train", "C9, P14")
def q_pseudo_select(spark, sf):
    """C9 + P14: unlabelled rows with prediction in [4, 7]: count, share, mean, std."""
    return round_doubles(C.pseudo_summary(calib_input(spark, sf), "pred"), 6)


@query("pseudo_union", PR_CTE + ", u as (select id, target as label, fold as own, 'train' as source from pf where is_train "
       "union all select id, p_a as label, null as own, 'pseudo' as source from pf where not is_train and p_a between 4 and 7)\n"
       "select id, round(label, 8) as label, source, mf.model_fold from u, range(5) mf(model_fold) "
       "where own is null or own <> mf.model_fold", "U1, M12")
def q_pseudo_union(spark, sf):
    """Per model fold, fold-train rows plus all pseudo-labelled rows."""
    out = C.pseudo_union(calib_input(spark, sf), "pred")
    return round_doubles(out.select("id", "label", "source", F.col("model_fold").cast("bigint")))


def _quad_sql():
    sums = {"n": "1", "sx": "x", "sx2": "x*x", "sx3": "x*x*x", "sx4": "x*x*x*x", "sy": "y", "sxy": "x*y",
            "sx2y": "x*x*y"}
    per = ", ".join(f"sum({e}) filter (where fold <> f.f) as {n}" for n, e in sums.items())
    return (PR_CTE + ", d as (select id, is_train, fold, p_a as x, target as y from pf)\n"
            f", m as (select f.f as fold, {per} from d, range(5) f(f) where d.is_train group by f.f)\n"
            ", a as (select fold, sx2 - sx*sx/n + 1 as a11, sx3 - sx*sx2/n as a12, sx4 - sx2*sx2/n + 1 as a22, "
            "sxy - sx*sy/n as d1, sx2y - sx2*sy/n as d2, sy/n as my, sx/n as mx, sx2/n as mx2 from m)\n"
            ", c as (select fold, ((a22*d1 - a12*d2) / (a11*a22 - a12*a12)) as b1, ((a11*d2 - a12*d1) / (a11*a22 - a12*a12)) as b2, "
            "my, mx, mx2 from a)\n, c2 as (select fold, my - b1*mx - b2*mx2 as b0, b1, b2 from c)\n"
            ", mc as (select avg(b0) as mb0, avg(b1) as mb1, avg(b2) as mb2 from c2)\n"
            "select d.id, round(greatest(0, least(10, case when d.is_train then c2.b0 + c2.b1*x + c2.b2*x*x "
            "else mb0 + mb1*x + mb2*x*x end)), 6) as calibrated from d cross join mc left join c2 on d.fold = c2.fold")


@query("calibrate_quadratic", _quad_sql(), "C3, F48")
def q_calibrate_quadratic(spark, sf):
    """Fold-safe quadratic ridge correction (alpha 1); test = mean of 5 fold fits; clipped."""
    out = C.calibrate_quadratic(calib_input(spark, sf))
    return round_doubles(out.select("id", "calibrated"), 6)


@query("fold_average", _quad_sql().split("select d.id, round(")[0]
       + "select d.id, count(*) as n_folds, round(avg(c2.b0 + c2.b1*x + c2.b2*x*x), 8) as pred "
         "from d cross join c2 where not d.is_train group by d.id", "G19")
def q_fold_average(spark, sf):
    """Each of the 5 fold models (quadratic correction) scores every test row;
    the test prediction is the mean over folds (k rows per test id, then averaged)."""
    base = calib_input(spark, sf)
    coef = C.quadratic_coefficients(base, "pred", "target", 5).where(F.col("fold") >= 0)
    test = base.where(~F.col("is_train")).select("id", "pred",
                                                 F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    from foldspark.operators.joins import attach_bounded
    scored = attach_bounded(test, coef, on="fold").select(
        "id", "fold", (F.col("b0") + F.col("b1") * F.col("pred") + F.col("b2") * F.col("pred") * F.col("pred"))
        .alias("p_fold"))
    out = B.average_over(scored, ["id"], value="p_fold", out="pred")
    return round_doubles(out.select("id", F.col("n_avg").alias("n_folds"), "pred"))


_PROBS = "[" + ", ".join(str(p) for p in C._probs(C.N_QUANTILE_BINS)) + "]"


def _bins_sql(split: str) -> str:
    return (PR_CTE + ", d as (select id, is_train, fold, p_a as x, target - p_a as r from pf)\n"
            f", e as (select f.f as fold, quantile_cont(x, {_PROBS}) filter (where d.fold <> f.f) as q "
            "from d, range(5) f(f) where d.is_train group by f.f "
            f"union all select -1 as fold, quantile_cont(x, {_PROBS}) as q from d where is_train)\n"
            ", ei as (select fold, list_slice(list_sort(list_distinct(q)), 2, len(list_distinct(q)) - 1) as inner_e from e)\n"
            ", tc as (select ei.fold, d.r, len(list_filter(ei.inner_e, lambda v: v <= d.x)) as bin from d join ei "
            "on d.is_train and (ei.fold = -1 or d.fold <> ei.fold))\n"
            ", bb as (select fold, bin, avg(r) as bias from tc group by fold, bin)\n"
            ", v as (select d.id, d.is_train, d.x, ei.fold, len(list_filter(ei.inner_e, lambda z: z <= d.x)) as bin "
            "from d join ei on ei.fold = case when d.is_train then d.fold else -1 end)\n"
            "select v.id, round(greatest(0, least(10, v.x + coalesce(bb.bias, 0))), 8) as calibrated from v "
            f"left join bb on bb.fold = v.fold and bb.bin = v.bin where {'v.is_train' if split == 'train' else 'not v.is_train'}")


@query("calibrate_bins", _bins_sql("train"), "C4, J7")
def q_calibrate_bins(spark, sf):
    """C4 + J7: fold-safe 20-quantile-bin bias correction of labelled rows, clipped."""
    out = C.calibrate_bins(calib_input(spark, sf))
    return round_doubles(out.where("is_train").select("id", "calibrated"))


@query("calibrate_bins_test", _bins_sql("test"), "C4, J7")
def q_calibrate_bins_test(spark, sf):
    """C4: test rows corrected with bins and biases of all labelled rows."""
    out = C.calibrate_bins(calib_input(spark, sf))
    return round_doubles(out.where(~F.col("is_train")).select("id", "calibrated"))


@query("calibrate_isotonic_oof", None, "C1, C2")
def q_calibrate_isotonic_oof(spark, sf):
    """C1 + C2: isotonic correction in-sample (naive) and fold-safe, side by side, clipped."""
    base = calib_input(spark, sf)
    both = C.calibrate_isotonic(base, out="iso_fold_safe", naive_out="iso_naive")
    return round_doubles(both.select("id", "is_train", "iso_fold_safe", "iso_naive"))


@query("calibration_choice", None, "C6, G17")
def q_calibration_choice(spark, sf):
    """OOF RMSE of each fold-safe correction against none; best by score."""
    base = calib_input(spark, sf)
    methods = {
        "none": base.select("id", "is_train", "target", F.col("pred").alias("calibrated")),
        "isotonic": C.calibrate_isotonic(base),
        "quadratic": C.calibrate_quadratic(base),
        "bins": C.calibrate_bins(base),
        "ridge": C.calibrate_ridge_residual(base.withColumn("stack", F.col("pred")), "stack", ["p_a", "p_b", "p_c"]),
    }
    long = None
    for name, df in methods.items():
        part = df.where("is_train").select(F.lit(name).alias("method"), "target", F.col("calibrated").alias("pred"))
        long = part if long is None else long.unionByName(part)
    # five rows, stored: the best of them is not a second pass over all corrections
    scores = stored(M.rmse(long, by=["method"]), "calibration-scores")
    best = B.best_by_score(scores, "method")
    from foldspark.operators.joins import attach_scalar_row
    return round_doubles(attach_scalar_row(scores, best), 6)
