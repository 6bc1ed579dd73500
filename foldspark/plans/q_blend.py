"""Queries for blends, stacking and experiment bookkeeping (survey step 4)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import blend as B
from foldspark.operators import folds
from foldspark.plans import fixtures as FX
from foldspark.plans.catalog import query
from foldspark.plans.q_metrics import model_preds
from foldspark.plans.q_prep import round_doubles

PR_CTE = FX.oracle_ctes(with_preds=True)
PL_CTE = FX.oracle_ctes(with_long=True)
MODELS = ["p_a", "p_b", "p_c"]


def wide_preds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.hash_folds(FX.preds(spark, sf), 5, 42)


@query("blend_equal", PR_CTE + "select id, round((p_a + p_b + p_c) / 3, 8) as blend from preds", "B1")
def q_blend_equal(spark, sf):
    """B1: equal-weight mean of three models per id, aligned by id on the long table."""
    long = model_preds(spark, sf, train_only=False)
    return round_doubles(B.weighted_mean_long(long))


_FIXED = {"b50_50": (["p_a", "p_b"], [0.5, 0.5]), "b60_40": (["p_a", "p_b"], [0.6, 0.4]),
          "b40_40_20": (["p_a", "p_b", "p_c"], [0.4, 0.4, 0.2]),
          "b45_45_10": (["p_a", "p_b", "p_c"], [0.45, 0.45, 0.1])}


def _fixed_sql(cols, wts):
    return " + ".join(f"{w} * {c}" for c, w in zip(cols, wts))


@query("blend_fixed", PR_CTE + "select id, " + ", ".join(
    f"round(greatest(0, least(10, {_fixed_sql(*v)})), 8) as {k}, "
    f"(({_fixed_sql(*v)}) < 0 or ({_fixed_sql(*v)}) > 10)::int as {k}_clipped" for k, v in _FIXED.items())
    + " from preds where not is_train", "B5, J3, P18, P19")
def q_blend_fixed(spark, sf):
    """B5 + P18 + P19: fixed 50/50, 60/40, 40/40/20, 45/45/10 blends of test predictions,
    clipped to [0, 10], with a flag for clipped rows."""
    df = wide_preds(spark, sf).where(~F.col("is_train"))
    for name, (cols, wts) in _FIXED.items():
        df = B.fixed_blend(df, cols, wts, name)
    return round_doubles(df.select("id", *[c for k in _FIXED for c in (k, f"{k}_clipped")]))


@query("blend_clip_count", PR_CTE + "select " + ", ".join(
    f"count(*) filter (where ({_fixed_sql(*v)}) < 0 or ({_fixed_sql(*v)}) > 10) as {k}_n_clipped"
    for k, v in _FIXED.items()) + ", count(*) as n from preds where not is_train", "P19")
def q_blend_clip_count(spark, sf):
    """Number of blended test values outside [0, 10] before clipping."""
    df = wide_preds(spark, sf).where(~F.col("is_train"))
    for name, (cols, wts) in _FIXED.items():
        df = B.fixed_blend(df, cols, wts, name)
    return df.agg(*[F.sum(f"{k}_clipped").cast("long").alias(f"{k}_n_clipped") for k in _FIXED],
                  F.count(F.lit(1)).alias("n"))


@query("blend_fallback", PR_CTE + "select id, round(greatest(0, least(10, 0.45 * p_a + 0.45 * p_b + 0.1 * p_c)), 8) "
       "as blend from preds where not is_train", "B5, S10")
def q_blend_fallback(spark, sf):
    """B5 + S10: 45/45/10 when all three inputs exist, else 60/40 on the first two."""
    df = wide_preds(spark, sf).where(~F.col("is_train"))
    out = B.blend_with_fallback(df, [(["p_a", "p_b", "p_c"], [0.45, 0.45, 0.1]), (["p_a", "p_b"], [0.6, 0.4])])
    return round_doubles(out.select("id", "blend"))


@query("blend_coverage", FX.oracle_ctes(with_preds=True) + ", a as (select distinct id from preds where not is_train)"
       ", b as (select distinct id from panel where not is_train)\n"
       "select (select count(*) from a where id not in (select id from b)) as only_left, "
       "(select count(*) from b where id not in (select id from a)) as only_right", "J4")
def q_blend_coverage(spark, sf):
    """Ids of the test predictions vs the test table, both directions (left-anti)."""
    a = FX.preds(spark, sf).where(~F.col("is_train")).select("id")
    b = FX.panel(spark, sf).where(~F.col("is_train")).select("id")
    return B.coverage_check(a, b)


@query("seed_average", PL_CTE + "select id, model, round(avg(pred), 8) as pred, count(*) as n_avg "
       "from preds_long group by id, model", "G18, K3, M15")
def q_seed_average(spark, sf):
    """Mean prediction over five seeds per (id, model)."""
    return round_doubles(B.average_over(FX.preds_long(spark, sf), ["id", "model"]))


@query("best_experiment", PR_CTE + ", s as (select model, sqrt(avg((target - pred) * (target - pred))) as rmse "
       "from preds unpivot (pred for model in (p_a, p_b, p_c)) where is_train group by model)\n"
       "select arg_min(model, rmse) as best_model, round(min(rmse), 6) as best_rmse from s", "G17")
def q_best_experiment(spark, sf):
    """Model with the lowest OOF RMSE (min_by over the score table)."""
    from foldspark.operators import metrics as M
    scores = M.rmse(model_preds(spark, sf), by=["model"])
    return round_doubles(B.best_by_score(scores), 6)


def experiment_store(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction store rows ``(experiment, split, id, pred)`` from the long predictions."""
    pl = FX.preds_long(spark, sf)
    return pl.select(F.concat(F.col("model"), F.lit("_seed"), F.col("seed").cast("string")).alias("experiment"),
                     F.when(F.col("is_train"), F.lit("oof")).otherwise(F.lit("test")).alias("split"),
                     "id", "pred")


@query("experiments_complete", PL_CTE + ", st as (select model || '_seed' || seed::varchar as experiment, "
       "case when is_train then 'oof' else 'test' end as split from preds_long)\n"
       "select experiment, count(*) filter (where split = 'oof') as n_oof, count(*) filter (where split = 'test') "
       "as n_test, (count(*) filter (where split = 'oof') > 0 and count(*) filter (where split = 'test') > 0) as complete "
       "from st where experiment not like '%ensemble%' group by experiment", "S8, S9, S11")
def q_experiments_complete(spark, sf):
    """Experiments (not ensembles) with both OOF and test rows."""
    st = experiment_store(spark, sf).where(~F.col("experiment").like("%ensemble%"))
    return B.complete_experiments(st)


@query("blend_optimal_2", PR_CTE + ", w as (select greatest(0, least(1, sum((target - p_b) * (p_a - p_b)) / "
       "sum((p_a - p_b) * (p_a - p_b)))) as w_a from preds where is_train)\n"
       "select round(w_a, 6) as w_a, round(1 - w_a, 6) as w_b, round(sqrt(avg((target - (w_a * p_a + (1 - w_a) * p_b)) * "
       "(target - (w_a * p_a + (1 - w_a) * p_b)))), 6) as rmse from preds, w where is_train group by w_a", "B2")
def q_blend_optimal_2(spark, sf):
    """B2 for two models: closed-form best convex weight, and the blend's RMSE."""
    tr = wide_preds(spark, sf).where("is_train")
    w = tr.agg(B.optimal_weight_2("p_a", "p_b").alias("w_a"))
    from foldspark.operators.joins import attach_scalar_row
    x = attach_scalar_row(tr, w)
    bl = F.col("w_a") * F.col("p_a") + (1 - F.col("w_a")) * F.col("p_b")
    out = x.groupBy("w_a").agg(F.sqrt(F.avg((F.col("target") - bl) * (F.col("target") - bl))).alias("rmse"))
    return round_doubles(out.select("w_a", (1 - F.col("w_a")).alias("w_b"), "rmse"), 6)


def _det3(m):
    """SQL text of a 3x3 determinant; m[i][j] are SQL expressions."""
    return (f"(({m[0][0]})*(({m[1][1]})*({m[2][2]})-({m[1][2]})*({m[2][1]}))"
            f"-({m[0][1]})*(({m[1][0]})*({m[2][2]})-({m[1][2]})*({m[2][0]}))"
            f"+({m[0][2]})*(({m[1][0]})*({m[2][1]})-({m[1][1]})*({m[2][0]})))")


def _simplex_oracle() -> str:
    """Best convex weights of three models by enumerating the candidate optima:
    vertices, edges (closed form), interior (C^-1 1 normalised, by Cramer's rule)."""
    c = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    mom = ", ".join(f"avg((target - p_{'abc'[i]}) * (target - p_{'abc'[j]})) as c{i}{j}"
                    for i in range(3) for j in range(i, 3))
    cands = []
    for i in range(3):
        w = ["1e0" if t == i else "0e0" for t in range(3)]
        cands.append(f"select {w[0]} as w0, {w[1]} as w1, {w[2]} as w2 from cm")
    for i, j in [(0, 1), (0, 2), (1, 2)]:
        t = f"(({c[j][j]}) - ({c[i][j]})) / (({c[i][i]}) + ({c[j][j]}) - 2 * ({c[i][j]}))"
        w = ["0e0"] * 3
        w[i], w[j] = f"({t})", f"(1 - ({t}))"
        cands.append(f"select {w[0]} as w0, {w[1]} as w1, {w[2]} as w2 from cm "
                     f"where ({c[i][i]}) + ({c[j][j]}) - 2 * ({c[i][j]}) > 0 and {t} between 0 and 1")
    # interior: solve C v = 1 (Cramer), w = v / sum(v)
    v = []
    for col in range(3):
        m = [[("1e0" if jj == col else c[ii][jj]) for jj in range(3)] for ii in range(3)]
        v.append(_det3(m))
    tot = f"(({v[0]}) + ({v[1]}) + ({v[2]}))"
    cands.append(f"select ({v[0]}) / {tot} as w0, ({v[1]}) / {tot} as w1, ({v[2]}) / {tot} as w2 from cm "
                 f"where {tot} <> 0")
    obj = " + ".join(f"w{i} * w{j} * {c[i][j]}" for i in range(3) for j in range(3))
    return (PR_CTE + f", cm as (select {mom} from preds where is_train)\n"
            + ", cand as (" + " union all ".join(cands) + ")\n"
            + f", sc as (select w0, w1, w2, {obj} as obj from cand, cm where w0 >= -1e-12 and w1 >= -1e-12 and w2 >= -1e-12)\n"
            + ", best as (select arg_min(w0, obj) as w0, arg_min(w1, obj) as w1, arg_min(w2, obj) as w2 from sc)\n"
            + "select id, is_train, round(w0 * p_a + w1 * p_b + w2 * p_c, 8) as blend, round(w0, 6) as w_p_a, "
              "round(w1, 6) as w_p_b, round(w2, 6) as w_p_c from preds, best")


def _nn_ridge_oracle(alpha: float = 1.0) -> str:
    """Non-negative ridge (intercept, 3 inputs) by enumerating supports: each
    support's unconstrained solution, keep the non-negative ones, take the lowest
    objective w'Qw - 2b'w."""
    names = ["p_a", "p_b", "p_c"]
    mom = ", ".join([f"count(*) * covar_pop({names[i]}, {names[j]}) + {alpha if i == j else 0} as q{i}{j}"
                     for i in range(3) for j in range(i, 3)]
                    + [f"count(*) * covar_pop({names[i]}, target) as b{i}" for i in range(3)]
                    + [f"avg({n}) as m{i}" for i, n in enumerate(names)] + ["avg(target) as my"])
    q = [[f"q{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    cands = ["select 0e0 as w0, 0e0 as w1, 0e0 as w2 from st"]
    for i in range(3):
        w = ["0e0"] * 3
        w[i] = f"(b{i} / {q[i][i]})"
        cands.append(f"select {w[0]} as w0, {w[1]} as w1, {w[2]} as w2 from st")
    for i, j in [(0, 1), (0, 2), (1, 2)]:
        det = f"({q[i][i]} * {q[j][j]} - {q[i][j]} * {q[i][j]})"
        w = ["0e0"] * 3
        w[i] = f"(({q[j][j]} * b{i} - {q[i][j]} * b{j}) / {det})"
        w[j] = f"(({q[i][i]} * b{j} - {q[i][j]} * b{i}) / {det})"
        cands.append(f"select {w[0]} as w0, {w[1]} as w1, {w[2]} as w2 from st")
    det = _det3(q)
    full = []
    for col in range(3):
        m = [[(f"b{ii}" if jj == col else q[ii][jj]) for jj in range(3)] for ii in range(3)]
        full.append(f"({_det3(m)}) / {det}")
    cands.append(f"select {full[0]} as w0, {full[1]} as w1, {full[2]} as w2 from st")
    obj = (" + ".join(f"w{i} * w{j} * {q[i][j]}" for i in range(3) for j in range(3))
           + " - 2 * (" + " + ".join(f"b{i} * w{i}" for i in range(3)) + ")")
    return (PR_CTE + f", st as (select {mom} from preds where is_train)\n"
            + ", cand as (" + " union all ".join(cands) + ")\n"
            + f", sc as (select w0, w1, w2, {obj} as obj, my - (w0 * m0 + w1 * m1 + w2 * m2) as icpt from cand, st "
              "where w0 >= 0 and w1 >= 0 and w2 >= 0)\n"
            + ", best as (select arg_min(w0, obj) as w0, arg_min(w1, obj) as w1, arg_min(w2, obj) as w2, "
              "arg_min(icpt, obj) as icpt from sc)\n"
            + "select id, is_train, round(icpt + w0 * p_a + w1 * p_b + w2 * p_c, 8) as stacked, round(icpt, 6) as intercept, "
              "round(w0, 6) as coef_p_a, round(w1, 6) as coef_p_b, round(w2, 6) as coef_p_c from preds, best")


@query("blend_optimal_n", _simplex_oracle(), "B2")
def q_blend_optimal_n(spark, sf):
    """B2 for n models: non-negative weights summing to one (moment matrix + driver QP),
    applied to every row."""
    df = wide_preds(spark, sf)
    w = B.optimal_weights(df.where("is_train"), MODELS)
    out = df.select("id", "is_train", B.weighted_sum(MODELS, w).alias("blend"),
                    *[F.round(F.lit(float(v)), 6).alias(f"w_{m}") for m, v in zip(MODELS, w)])
    return round_doubles(out)


@query("stack_ridge", _nn_ridge_oracle(1.0), "B3")
def q_stack_ridge(spark, sf):
    """Ridge stack (alpha 1, intercept, non-negative coefficients) fitted on OOF rows,
    scored on all rows (in-sample on labelled rows, as the source)."""
    df = wide_preds(spark, sf)
    coef, icpt = B.ridge_stack(df.where("is_train"), MODELS, alpha=1.0)
    out = df.select("id", "is_train", B.linear_score(MODELS, coef, icpt).alias("stacked"),
                    F.round(F.lit(icpt), 6).alias("intercept"),
                    *[F.round(F.lit(float(v)), 6).alias(f"coef_{m}") for m, v in zip(MODELS, coef)])
    return round_doubles(out)


def _compare_oracle() -> str:
    opt = _simplex_oracle().rsplit("\nselect id, is_train", 1)[0]
    stk = _nn_ridge_oracle(1.0).rsplit("\nselect id, is_train", 1)[0]
    # rename the stack's CTEs so both candidate sets live in one query
    stk_body = stk[len(PR_CTE):]
    for a, b in [("st as", "st2 as"), ("from st", "from st2"), (", st\n", ", st2\n"), ("cand", "cand2"),
                 ("sc as", "sc2 as"), ("from sc", "from sc2"), ("best as", "best2 as")]:
        stk_body = stk_body.replace(a, b)
    stk_body = stk_body.replace("from cand2, st ", "from cand2, st2 ")
    return (opt + stk_body + "\n"
            "select 'equal' as method, round(sqrt(avg((target - (p_a + p_b + p_c) / 3) * (target - (p_a + p_b + p_c) / 3))), 6) as rmse, "
            "round(1e0 / 3, 6) as w_p_a, round(1e0 / 3, 6) as w_p_b, round(1e0 / 3, 6) as w_p_c, 0e0 as intercept "
            "from preds where is_train\nunion all\n"
            "select 'optimized', round(sqrt(avg((target - (w0 * p_a + w1 * p_b + w2 * p_c)) * (target - (w0 * p_a + w1 * p_b + w2 * p_c)))), 6), "
            "round(w0, 6), round(w1, 6), round(w2, 6), 0e0 from preds, best where is_train group by w0, w1, w2\nunion all\n"
            "select 'stacked', round(sqrt(avg((target - (icpt + w0 * p_a + w1 * p_b + w2 * p_c)) * (target - (icpt + w0 * p_a + w1 * p_b + w2 * p_c)))), 6), "
            "round(w0, 6), round(w1, 6), round(w2, 6), round(icpt, 6) from preds, best2 where is_train group by w0, w1, w2, icpt")


@query("blend_compare", _compare_oracle(), "B4")
def q_blend_compare(spark, sf):
    """RMSE of equal, optimised (convex) and stacked (non-negative ridge) blends,
    with their weights and intercept."""
    df = wide_preds(spark, sf).where("is_train")
    return round_doubles(B.compare_blends(df, MODELS), 6)
