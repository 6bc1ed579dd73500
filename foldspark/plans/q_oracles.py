"""Queries that hold the learners' surroundings against SQL: run matrix, nested encodings, imputation, residual
ridge, importances, model columns, and the sources and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions import exprs as X
from foldspark.functions import recipe as R
from foldspark.operators import blend as B
from foldspark.operators import calibrate as C
from foldspark.operators import clean, encode, folds
from foldspark.operators.joins import coverage
from foldspark.plans import fixtures as FX
from foldspark.plans import runs
from foldspark.plans.catalog import fold_sql, query
from foldspark.plans.models import learner, quick
from foldspark.plans.q_calibrate import PR_CTE, calib_input
from foldspark.plans.q_models import FEATURES, model_frame
from foldspark.plans.q_prep import P_CTE, SQL_FEATURES, PM_CTE, cleaned_panel, round_doubles
from foldspark.sources import csv as CSV
from foldspark.sources import store
from foldspark.sources.scratch import discard, shared_path, stored

# ---- M15: run matrix ---------------------------------------------------------------------

_SEEDS = ", ".join(f"({s})" for s in runs.SEEDS)
_SEED_FOLD = "((('0x'||substr(md5(id::varchar||':'||seed::varchar),1,8))::BIGINT) % 5)"
_SEED_PRED = "my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2"


@query("run_matrix_ridge", P_CTE + ", d as (select id, is_train, seed, case when is_train then " + _SEED_FOLD + " end as fold, "
       f"age::double as x1, work_hours as x2, target as y from p cross join (values {_SEEDS}) s(seed))\n"
       ", m as (select seed, f.f as f, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, "
       "stddev_pop(x2) as s2, covar_pop(x1, x2) as c12, covar_pop(x1, y) as c1, covar_pop(x2, y) as c2 "
       "from d, range(5) f(f) where is_train and fold <> f.f group by all)\n"
       ", a(model, alpha) as (values ('ridge_1', 1e0), ('ridge_50', 5e1))\n"
       ", w as (select *, (a * b1 - r * b2) / (a * a - r * r) as w1, (a * b2 - r * b1) / (a * a - r * r) as w2 from ("
       "select *, n * c12 / (s1 * s2) as r, n + alpha as a, n * c1 / s1 as b1, n * c2 / s2 as b2 from m, a))\n"
       ", e as (select model, id, 'oof' as split, avg(" + _SEED_PRED + ") as pred, count(*) as n_avg from d join w on d.seed = w.seed "
       "and d.fold = w.f where is_train group by model, id union all select model, id, 'test', avg(" + _SEED_PRED + "), count(*) "
       "from d join w on d.seed = w.seed where not is_train group by model, id)\n"
       "select id, split, model, round(pred, 4) as pred, n_avg, 50 as n_fits, 0 as n_refits, 10::bigint as n_records from e",
       "M15, K3, G18, G19, S12, S13")
def q_run_matrix_ridge(spark, sf):
    """M15 with learners that have a closed form: 5 seeds x 2 ridges x 5 folds, seed averages; a second call on the
    same store fits nothing; one log record a learner and seed."""
    p = cleaned_panel(spark, sf)
    path = shared_path(spark, "run-matrix")
    ridges = {"ridge_1": learner("ridge"), "ridge_50": learner("ridge")}
    ridges["ridge_50"].ridge_alpha = 50.0
    first = runs.run_matrix(p, ["age", "work_hours"], ridges, path)
    again = runs.run_matrix(p, ["age", "work_hours"], ridges, path)
    records = store.read_experiment_log(spark, f"{path}/log").count()
    return again.averaged().select("id", "split", "model", F.round("pred", 4).alias("pred"), "n_avg",
                                   F.lit(len(first.fitted)).alias("n_fits"), F.lit(len(again.fitted)).alias("n_refits"),
                                   F.lit(records).cast("long").alias("n_records"))


# ---- M3: nested encodings ------------------------------------------------------------------

@query("encode_nested", P_CTE + f", d as (select id, is_train, target as y, coalesce(chronotype, 'missing') as c, "
       f"case when is_train then {fold_sql()} end as fold, {fold_sql(seed=1042)} as i from p)\n"
       ", r as (select d.*, f.f as f from d, range(5) f(f))\n"
       ", t as (select f.f as f, c, i, sum(y) as s, count(*) as n from d, range(5) f(f) where is_train and fold <> f.f group by all)\n"
       ", g as (select f, sum(s) / sum(n) as gm from t group by f)\n"
       "select r.id, r.f::int as model_fold, round((coalesce(sum(t.s), 0) + 10 * g.gm) / (coalesce(sum(t.n), 0) + 10), 8) as enc "
       "from r join g on r.f = g.f left join t on t.f = r.f and t.c = r.c and (not (r.is_train and r.fold <> r.f) or t.i <> r.i) "
       "group by r.id, r.f, g.gm", "M3, E1, E3, P5")
def q_encode_nested(spark, sf):
    """M3: the encoding that every row has in every fold's model, leave-two-folds-out for rows that train it."""
    p = folds.hash_folds(clean.missing_as_level(cleaned_panel(spark, sf), ["chronotype"]), 5, 42)
    p = p.withColumn("fold", F.when(F.col("is_train"), F.col("fold")))
    p = folds.hash_folds(p, 5, 1042, out="inner_fold")
    e = encode.nested_target_encoding(p, ["chronotype"], "target", "fold", "inner_fold", "is_train", 5, 5)
    return round_doubles(e.select("id", F.posexplode("fe_te_chronotype").alias("model_fold", "enc")))


# ---- M14: imputation -----------------------------------------------------------------------

def _impute_sql(rounds: int) -> str:
    sql = P_CTE + (", v0 as (select id, bmi as a0, stress as b0, coalesce(bmi, avg(bmi) over ()) as a, "
                   "coalesce(stress, avg(stress) over ()) as b from p)\n")
    for r in range(rounds):
        # bmi has fewer nulls (one id in 17) than stress (one in 11)
        sql += (f", w{r} as (select id, a0, b0, b, coalesce(a0, (select regr_intercept(a0, b) + 0 from v{r} where a0 is not null) "
                f"+ (select regr_slope(a0, b) from v{r} where a0 is not null) * b) as a from v{r})\n"
                f", v{r + 1} as (select id, a0, b0, a, coalesce(b0, (select regr_intercept(b0, a) from w{r} where b0 is not null) "
                f"+ (select regr_slope(b0, a) from w{r} where b0 is not null) * a) as b from w{r})\n")
    return sql + f"select id, round(a, 6) as bmi, round(b, 6) as stress from v{rounds}"


@query("impute_two_columns", _impute_sql(3), "M14, U2")
def q_impute_two_columns(spark, sf):
    """M14 on two columns with gaps, three rounds of least squares, the column with fewer nulls first."""
    return round_doubles(runs.impute_chained(cleaned_panel(spark, sf), ["stress", "bmi"], rounds=3).select("id", "bmi", "stress"), 6)


# ---- C5: residual ridge ----------------------------------------------------------------------

def residual_ridge_sql() -> str:
    """Normal equations per fold and Gauss-Jordan elimination over the augmented matrix."""
    x = ["stack", "p_a", "p_b", "p_c", "stack * stack", "abs(stack - 5)"]
    n = len(x)
    rows = ", ".join("[" + ", ".join([f"count(*) * covar_pop(m[{i + 1}], m[{j + 1}])" + (" + 2" if i == j else "") for j in range(n)]
                                     + [f"count(*) * covar_pop(m[{i + 1}], r)"]) + "]" for i in range(n))
    means = "[" + ", ".join(f"avg(m[{i + 1}])" for i in range(n)) + "]"
    return (PR_CTE.replace("with ", "with recursive ", 1)
            + ", d as (select id, is_train, fold, stack, target - stack as r, [" + ", ".join(x) + "] as m from "
            "(select *, (p_a + p_b + p_c) / 3 as stack from pf))\n"
            f", e as (select f.f as f, {means} as mu, avg(r) as mr, [{rows}] as g from d, range(5) f(f) "
            "where is_train and fold <> f.f group by f.f)\n"
            ", j(f, mu, mr, g, step) as (select f, mu, mr, g, 1 from e union all select f, mu, mr, "
            "list_transform(range(1, 7), lambda i: list_transform(range(1, 8), lambda c: case when i = step then g[step][c] / g[step][step] "
            "else g[i][c] - g[i][step] * g[step][c] / g[step][step] end)), step + 1 from j where step <= 6)\n"
            ", w as (select f, list_transform(range(1, 7), lambda i: g[i][7]) as w, mr, mu from j where step = 7)\n"
            ", s as (select id, is_train, stack, avg(mr + list_sum(list_transform(range(1, 7), lambda i: w[i] * (m[i] - mu[i])))) as fix "
            "from d join w on not d.is_train or d.fold = w.f group by all)\n")


@query("calibrate_ridge_residual", residual_ridge_sql()
       + "select id, is_train, round(greatest(0, least(10, stack + fix)), 6) as calibrated from s", "C5, F47")
def q_calibrate_ridge_residual(spark, sf):
    """Fold-safe ridge (alpha 2) of the stack's residual on meta features
    (stack, three model predictions, stack^2, |stack-5|); test uses the real model predictions."""
    p = calib_input(spark, sf).withColumn("stack", (F.col("p_a") + F.col("p_b") + F.col("p_c")) / 3)
    out = C.calibrate_ridge_residual(p, "stack", ["p_a", "p_b", "p_c"])
    return round_doubles(out.select("id", "is_train", "calibrated"), 6)


# ---- G22: importances -------------------------------------------------------------------------

@query("importance_contract", P_CTE + f"select {len(FEATURES)}::bigint as n_features, 5::bigint as n_folds, true as fold_sums_to_one, "
       "true as none_negative from p limit 1", "G22")
def q_importance_contract(spark, sf):
    """Each fold's importances of all features are there, not negative and sum to one."""
    res = runs.run_cv(model_frame(spark, sf), FEATURES, quick("gbt_depthwise", patience=1))
    t = spark.createDataFrame(res.importances, "fold int, feature string, importance double")
    per = t.groupBy("fold").agg(F.sum("importance").alias("s"), F.min("importance").alias("low"), F.count_distinct("feature").alias("n"))
    return per.agg(F.min("n").alias("n_features"), F.count("*").alias("n_folds"),
                   F.bool_and(F.abs(F.col("s") - 1) < 1e-9).alias("fold_sums_to_one"), F.bool_and(F.col("low") >= 0).alias("none_negative"))


# ---- M7: class probabilities ---------------------------------------------------------------------

@query("class_probabilities", P_CTE + "select count(*) as n_rows, count(distinct id) as n_ids, 11 as n_classes, true as sum_to_one, "
       "true as within_range, true as beats_mean from p where is_train", "M7, K2, F45")
def q_class_probabilities(spark, sf):
    """M7: out-of-fold probabilities of the boosted 11-class model: one row a labelled id, each row sums to one, the
    expected value lies in the classes' range and beats the mean."""
    mf = model_frame(spark, sf, stratified=True).withColumn("cls_label", F.when(F.col("is_train"), X.int_class("target")))
    feats = ["age", "stress", "work_hours", "screen_min", "bmi", "steps"]
    prepared = runs.prepare(mf, feats, target="cls_label")
    base, meds = prepared.folded()
    parts = [runs._fit_fold(f, runs._filled(base, feats, meds, f), feats, quick("class_boost", maxIter=2), 42, "ev", None, [], {},
                            labels=True).where("split = 'oof'") for f in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    spread = base.where("__train").agg(F.stddev_pop("label")).first()[0]
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.max(F.size("probability")).alias("n_classes"),
                   F.bool_and(F.abs(total - 1) < 1e-9).alias("sum_to_one"),
                   F.bool_and((F.col("pred") >= 0) & (F.col("pred") <= 10)).alias("within_range"),
                   (F.sqrt(F.avg((F.col("pred") - F.col("label")) ** 2)) < F.lit(spread)).alias("beats_mean"))


# ---- J5, B2 and B3: many model columns --------------------------------------------------------------

PL_CTE = FX.oracle_ctes(with_long=True)


@query("blend_wide", PL_CTE + "select id, round(max(pred) filter (where model = 'a'), 8) as a, round(max(pred) filter (where model = 'b'), 8) as b, "
       "round(max(pred) filter (where model = 'c' and id % 5 > 0), 8) as c from preds_long where seed = 42 group by id", "J5")
def q_blend_wide(spark, sf):
    """The long predictions of one seed side by side; a model that lacks an id is null there."""
    long = FX.preds_long(spark, sf).where("seed = 42 and (model <> 'c' or id % 5 > 0)")
    return round_doubles(B.wide(long, ["a", "b", "c"]))


_PAIRS = [(f"{m}_{s}", m, s) for m in "abc" for s in runs.SEEDS]


@query("moments_many_columns", PL_CTE + ", w as (select id, min(target) as y, " + ", ".join(
    f"max(pred) filter (where model = '{m}' and seed = {s}) as {n}" for n, m, s in _PAIRS) + " from preds_long where is_train group by id)\n"
    + " union all ".join(f"select '{a[0]}' as c1, '{b[0]}' as c2, round(avg((y - {a[0]}) * (y - {b[0]})), 6) as residual_product, "
                         f"round(covar_pop({a[0]}, {b[0]}), 6) as covariance from w" for i, a in enumerate(_PAIRS) for b in _PAIRS[i:]),
    "J5, B2, B3")
def q_moments_many_columns(spark, sf):
    """B2 and B3 on 15 model columns (3 models x 5 seeds): the residual products and covariances that their weights come from."""
    long = FX.preds_long(spark, sf).where("is_train").withColumn("name", F.concat_ws("_", "model", "seed"))
    names = [n for n, _, _ in _PAIRS]
    w = stored(B.wide(long, names, ["id", "target"], "name"), "wide-predictions")       # read twice, shuffled once
    prod = B.residual_moments(w, names)
    gram, _, _, _, n = B.centred_moments(w, names)
    discard(w)
    rows = [(a, names[j], float(prod[i, j]), float(gram[i, j] / n)) for i, a in enumerate(names) for j in range(i, len(names))]
    return round_doubles(spark.createDataFrame(rows, "c1 string, c2 string, residual_product double, covariance double"), 6)


# ---- sources and sinks ------------------------------------------------------------------------------

@query("csv_by_name", P_CTE + "select id, round(bmi, 8) as bmi, stress, 'a, \"b\"' || chr(10) || gender as note, "
       "(select count(*) from p where id % 50 = 3) as n_quarantined from p where id % 50 <> 3", "S1")
def q_csv_by_name(spark, sf):
    """Columns by header name (other order, one more column), line breaks and quotes in texts, unreadable rows aside."""
    p = cleaned_panel(spark, sf)
    bmi = F.when(F.col("id") % 50 == 3, F.lit("12abc")).otherwise(F.coalesce(F.col("bmi").cast("string"), F.lit("NaN")))
    path = shared_path(spark, "csv")
    p.select(F.concat(F.lit('a, "b"\n'), "gender").alias("note"), bmi.alias("bmi"), F.lit("x").alias("other"), "id", "stress").write.option(
        "header", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("bmi", T.DoubleType()),
                           T.StructField("stress", T.DoubleType()), T.StructField("note", T.StringType())])
    good, bad = CSV.read_csv_quarantined(spark, path, schema)
    return round_doubles(good.withColumn("n_quarantined", F.lit(bad.count()).cast("long")))


@query("load_clean", P_CTE + "select id, is_train, country, stress, round(case when is_train then target end, 8) as target from p",
       "S1, S3, P1, P2, U2")
def q_load_clean(spark, sf):
    """S3 + U2: train and test files read, cleaned and stacked with their split flag."""
    p = FX.panel(spark, sf)
    out = {}
    for name, rows in (("train", p.where("is_train")), ("test", p.where("not is_train").drop("target"))):
        out[name] = shared_path(spark, f"csv-{name}")
        cols = ["id", "country", "stress", *(["target"] if name == "train" else [])]
        rows.select(*cols).write.option("header", True).option("nullValue", "NA").csv(out[name])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("country", T.StringType()),
                           T.StructField("stress", T.DoubleType()), T.StructField("target", T.DoubleType())])
    df = CSV.load_and_clean(spark, out["train"], out["test"], schema, "target", "country", FX.PANEL_ALIASES)
    return round_doubles(df.select("id", "is_train", "country", "stress", "target"))


@query("store_fallback", PR_CTE + "select id, round(p_b, 8) as pred, 'second' as source, round(greatest(0, least(10, "
       "0.6 * p_a + 0.4 * p_b)), 8) as blend from preds where not is_train", "S4, S5, S10, B5")
def q_store_fallback(spark, sf):
    """The preferred experiment has no test rows, so the second candidate is read, and a blend whose third input is
    absent falls back to 60/40."""
    p = FX.preds(spark, sf)
    path = shared_path(spark, "store")
    oof = p.where("is_train").select("id", F.lit("oof").alias("split"), F.lit(0).alias("fold"), F.col("p_a").alias("pred"))
    test = p.where("not is_train").select("id", F.lit("test").alias("split"), F.lit(None).cast("int").alias("fold"), F.col("p_b").alias("pred"))
    store.save_predictions(oof, path, "first")
    store.save_predictions(test, path, "second")
    name = store.first_available(spark, path, ["first", "second", "third"])
    got = store.load_predictions(spark, path, name, "test").select("id", "pred", F.lit(name).alias("source"))
    both = got.join(p.select("id", "p_a", F.col("p_b")), "id")
    out = B.blend_with_fallback(both, [(["p_a", "p_b", "p_c"], [0.45, 0.45, 0.1]), (["p_a", "p_b"], [0.6, 0.4])])
    return round_doubles(out.select("id", "pred", "source", "blend"))


@query("run_log", PR_CTE + ", e as (select m.model, fold, sqrt(avg((target - case m.model when 'a' then p_a else p_b end) ** 2)) as r "
       "from pf, (values ('a'), ('b')) m(model) where is_train group by all)\n"
       "select model as experiment_name, round(avg(r), 6) as cv_rmse, round(stddev_pop(r), 6) as cv_std, count(*)::int as n_folds, "
       "round(list(r order by fold)[1], 6) as first_fold, 'p_' || model as column_name from e group by model", "S12, S13, G4")
def q_run_log(spark, sf):
    """S12 + S13: two experiments scored by fold, appended to the log one after the other, the log read back."""
    from foldspark.operators import metrics as M
    base = calib_input(spark, sf).where("is_train")
    path = shared_path(spark, "log")
    for m in ("a", "b"):
        s = M.fold_scores(base.withColumn("pred", F.col(f"p_{m}"))).first()
        scores = [r["fold_rmse"] for r in sorted(s["fold_scores"], key=lambda r: r["fold"])]
        store.log_experiment(spark, path, m, s["mean_fold_rmse"], s["cv_std"], scores, 1.0, {"column": f"p_{m}"})
    return round_doubles(store.read_experiment_log(spark, path).select(
        "experiment_name", "cv_rmse", "cv_std", F.size("fold_scores").alias("n_folds"),
        F.col("fold_scores")[0].alias("first_fold"), F.col("extra")["column"].alias("column_name")), 6)


@query("params_round_trip", PR_CTE + "select name, round(v, 6) as mean, n from (select 'model' as name, avg(p_b) as v, count(*)::double as n "
       "from preds union all select 'other', avg(p_c), 0e0 from preds)", "S13, S14")
def q_params_round_trip(spark, sf):
    """S14 + S13: parameters saved under two names, one of them twice; the last ones come back."""
    p = FX.preds(spark, sf)
    r = p.agg(F.avg("p_a"), F.avg("p_b"), F.avg("p_c"), F.count("*")).first()
    path = shared_path(spark, "params")
    store.save_params(spark, path, "model", {"mean": r[0], "n": 1})
    store.save_params(spark, path, "other", {"mean": r[2], "n": 0})
    store.save_params(spark, path, "model", {"mean": r[1], "n": r[3]})
    rows = [(n, *(store.load_params(spark, path, n)[k] for k in ("mean", "n"))) for n in ("model", "other")]
    return round_doubles(spark.createDataFrame(rows, "name string, mean double, n double"), 6)


# ---- cleaning and lookups ------------------------------------------------------------------------------

@query("aliases_both_ways", FX.oracle_ctes(with_preds=False) + "select id, case country when 'NATION_1' then 'NATION_1_ALT' when 'NATION_2' then "
       "'NATION_2_ALT' else country end as country from panel", "P1b")
def q_aliases_both_ways(spark, sf):
    """The dictionary the other way round, given as a table."""
    turned = spark.createDataFrame([(v, k) for k, v in FX.PANEL_ALIASES.items()], "alias string, canonical string")
    return clean.normalize_aliases(FX.panel(spark, sf), "country", turned).select("id", "country")


@query("feature_lists", P_CTE + "select column_name as col, data_type not in ('VARCHAR', 'BOOLEAN') as is_numeric, n_rows from "
       "(describe panel), (select count(*) as n_rows from panel)".replace("(describe panel)", "(select unnest(['is_train', "
       + ", ".join(f"'{c}'" for c in [*FX.PANEL_NUMERIC, *FX.PANEL_CATEGORIES]) + "]) as column_name, unnest(['BOOLEAN', "
       + ", ".join(["'DOUBLE'"] * len(FX.PANEL_NUMERIC) + ["'VARCHAR'"] * len(FX.PANEL_CATEGORIES)) + "]) as data_type)"), "P6, P7")
def q_feature_lists(spark, sf):
    """P6 + P7: every column but id and target, and which of them are numeric."""
    p = FX.panel(spark, sf)
    numeric = set(clean.numeric_columns(p, exclude=("id", "target")))
    rows = [(c, c in numeric) for c in clean.feature_columns(p)]
    return spark.createDataFrame(rows, "col string, is_numeric boolean").withColumn("n_rows", F.lit(p.count()).cast("long"))


_GROUPED = [f for f in R.feature_names(R.SLEEP + R.DEMOGRAPHIC + R.RATIO)]


@query("grouped_adders", P_CTE + PM_CTE + "select id, " + ", ".join(f"round({SQL_FEATURES[f]}, 8) as {f}" for f in _GROUPED) + " from pm", "FV3, X3")
def q_grouped_adders(spark, sf):
    """FV3 + X3: a chain of grouped adders by DataFrame.transform."""
    out = cleaned_panel(spark, sf).transform(R.add_sleep).transform(R.add_demographic).transform(R.add_ratio)
    return round_doubles(out.select("id", *_GROUPED))


@query("coverage_gap", P_CTE + "select (select count(*) from p where id % 7 = 0) as only_left, (select count(*) from p where id % 7 <> 0 "
       "and id % 9 = 0) as only_right", "J4")
def q_coverage_gap(spark, sf):
    """Two prediction sets with gaps and repeated ids; the ids that only one of them has."""
    ids = cleaned_panel(spark, sf).select("id")
    a = ids.where("id % 7 = 0 or id % 9 <> 0")
    b = ids.where("id % 7 <> 0").unionByName(ids.where("id % 21 = 1"))
    return coverage(a, b)


@query("dictionary_lookup", P_CTE + ", m as (select occupation as k, avg(target) as v from p where is_train and occupation is not null and "
       "occupation <> (select min(occupation) from p) group by occupation), g as (select avg(target) as g from p where is_train)\n"
       "select p.id, round(coalesce(m.v, g.g), 8) as occupation_mean from p cross join g left join m on p.occupation = m.k", "J2")
def q_dictionary_lookup(spark, sf):
    """A level's mean from a dictionary that lacks a level; unknown and null levels take the overall mean."""
    p = cleaned_panel(spark, sf)
    tr = p.where("is_train")
    row = p.agg(F.min("occupation").alias("first")).first()
    mapping = tr.where(F.col("occupation") != row["first"]).groupBy("occupation").agg(F.avg("target"))
    overall = tr.agg(F.avg("target")).first()[0]
    return round_doubles(encode.dictionary_lookup(p, "occupation", mapping, F.lit(overall), "occupation_mean").select("id", "occupation_mean"))
