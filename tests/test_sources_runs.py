from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.sources import csv as CSV
from foldspark.sources import store


def test_csv_missing_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,x,c\n1,NA,a\n2,NaN,None\n3,2.5,\n4,null,b\n5,3,NA\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()),
                           T.StructField("c", T.StringType())])
    rows = {r.id: r for r in CSV.read_csv(spark, str(p), schema).collect()}
    assert rows[1].x is None and rows[2].x is None and rows[4].x is None
    assert rows[3].x == 2.5 and rows[5].x == 3.0
    assert rows[2].c is None and rows[3].c is None and rows[5].c is None and rows[1].c == "a"
    avg = CSV.read_csv(spark, str(p), schema).agg(F.avg("x")).first()[0]
    assert avg == pytest.approx(2.75)                                  # nulls skipped, no NaN


def test_prediction_store_roundtrip(spark, tmp_path):
    path = str(tmp_path / "preds")
    df = spark.createDataFrame([(1, "oof", 0, 1.0), (2, "test", None, 2.0)], "id long, split string, fold int, pred double")
    store.save_predictions(df, path, "m1")
    df2 = df.withColumn("pred", F.col("pred") + 10)
    store.save_predictions(df2, path, "m1")
    store.save_predictions(df.where("split = 'oof'"), path, "m2_ensemble")
    latest = store.load_predictions(spark, path, "m1").toPandas()
    assert len(latest) == 2 and set(latest.pred) == {11.0, 12.0}
    ex = store.list_experiments(spark, path).toPandas()
    assert list(ex.experiment) == ["m1"] and bool(ex.complete.iloc[0])
    assert store.first_available(spark, path, ["zzz", "m2_ensemble", "m1"]) == "m1"
    assert store.missing_experiments(spark, path, ["m1", "zzz"], split="test") == ["zzz"]


def test_submission_and_logs(spark, tmp_path):
    preds = spark.createDataFrame([(3, 11.0), (1, -1.0), (2, 5.0)], "id long, pred double")
    out = str(tmp_path / "sub")
    store.save_submission(preds, out, "score")
    sub = pd.concat(pd.read_csv(f) for f in (tmp_path / "sub").glob("*.csv"))
    assert list(sub.columns) == ["id", "score"] and list(sub.id) == [1, 2, 3]
    assert list(sub.score) == [0.0, 5.0, 10.0]
    log = str(tmp_path / "log")
    store.log_experiment(spark, log, "e1", 1.2, 0.01, [1.1, 1.3], 3.0, {"model": "gbt"}, {"stack_rmse": 1.1})
    store.log_experiment(spark, log, "e2", 1.1, 0.02, [1.0, 1.2], 4.0)
    lg = store.read_experiment_log(spark, log).orderBy("experiment_name").collect()
    assert [r.experiment_name for r in lg] == ["e1", "e2"] and lg[0].fold_scores == [1.1, 1.3]
    assert lg[0].extra["model"] == "gbt"
    pp = str(tmp_path / "params")
    store.save_params(spark, pp, "gbt", {"maxDepth": 5, "stepSize": 0.1})
    assert store.load_params(spark, pp, "gbt") == {"maxDepth": 5.0, "stepSize": 0.1}


def _numpy_ridge_fold(pdf, feats, f, alpha=1.0):
    tr = pdf[pdf.is_train]
    fit, va = tr[tr.fold != f], tr[tr.fold == f]
    med = fit[feats].median()
    Xf, Xv = fit[feats].fillna(med), va[feats].fillna(med)
    mu, sd = Xf.mean(), Xf.std(ddof=0).replace(0, 1)
    Zf, Zv = (Xf - mu) / sd, (Xv - mu) / sd
    zm, ym = Zf.mean().values, fit.target.mean()
    A = (Zf.values - zm)
    w = np.linalg.solve(A.T @ A + alpha * np.eye(len(feats)), A.T @ (fit.target.values - ym))
    return va.index, ym + (Zv.values - zm) @ w


def test_ridge_sufficient_statistics_exact(spark, sf):
    from foldspark.plans import q_models as Q, runs
    feats = Q.FEATURES
    mf = Q.model_frame(spark, sf)
    res = runs.ridge_cv(mf, feats, alpha=1.0)
    oof = res.oof().toPandas().set_index("id").sort_index()
    pdf = mf.select("id", "is_train", "fold", "target", *feats).toPandas().set_index("id").sort_index()
    for f in range(5):
        idx, pred = _numpy_ridge_fold(pdf, feats, f)
        assert np.allclose(oof.loc[idx, "pred"].values, pred, atol=1e-9)
    assert res.test_mean().count() == mf.where("not is_train").count()


def test_cv_ridge_matches_closed_form(spark, sf):
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    feats = ["age", "bmi", "stress", "steps", "caffeine_mg"]
    mf = Q.model_frame(spark, sf)
    res = runs.run_cv(mf, feats, learner("ridge"))
    oof = res.oof().toPandas().set_index("id").sort_index()
    pdf = mf.select("id", "is_train", "fold", "target", *feats).toPandas().set_index("id").sort_index()
    tr = pdf[pdf.is_train]
    assert set(oof.index) == set(tr.index)                          # every labelled row once
    f = 1
    fit, va = tr[tr.fold != f], tr[tr.fold == f]
    med = fit[feats].median()
    Xf, Xv = fit[feats].fillna(med), va[feats].fillna(med)
    mu, sd = Xf.mean(), Xf.std(ddof=0).replace(0, 1)
    Zf, Zv = (Xf - mu) / sd, (Xv - mu) / sd
    zm, ym = Zf.mean().values, fit.target.mean()
    A = (Zf.values - zm)
    w = np.linalg.solve(A.T @ A + 1.0 * np.eye(len(feats)), A.T @ (fit.target.values - ym))
    pred = ym + (Zv.values - zm) @ w
    assert np.allclose(oof.loc[va.index, "pred"].values, pred, atol=1e-6)


def test_cv_forest_signal_and_repeatable(spark, sf):
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    mf = Q.model_frame(spark, sf)
    a = runs.run_cv(mf, Q.FEATURES, learner("forest", numTrees=5, maxDepth=5))
    b = runs.run_cv(mf, Q.FEATURES, learner("forest", numTrees=5, maxDepth=5))
    sa = a.scores(mf).first()
    std = mf.where("is_train").agg(F.stddev("target")).first()[0]
    assert sa.cv_rmse < std
    pa = a.oof().toPandas().set_index("id").sort_index().pred
    pb = b.oof().toPandas().set_index("id").sort_index().pred
    assert np.allclose(pa, pb)
    assert a.test_mean().count() == mf.where("not is_train").count()


def test_impute_chained_fills_only_missing(spark):
    rng = np.random.default_rng(0)
    n = 200
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": x, "b": 2 * x + rng.normal(0, 0.1, n), "c": rng.normal(size=n)})
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).select("id", "a", F.nanvl("b", F.lit(None).cast("double")).alias("b"), "c")
    from foldspark.plans import runs
    out = runs.impute_chained(df, ["a", "b", "c"], rounds=2).toPandas().set_index("id").sort_index()
    miss = pdf.b.isna().values
    assert out.b.notna().all()
    assert np.allclose(out.b.values[~miss], pdf.b.values[~miss])
    assert np.abs(out.b.values[miss] - 2 * x[miss]).max() < 0.5


def test_early_stop_truncation_equals_refit(spark, sf):
    """The model cut at the best round predicts exactly like a refit with that many rounds."""
    from pyspark.ml.feature import VectorAssembler
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    feats = ["age", "steps", "work_hours", "screen_min", "nap_min", "resting_bpm"]   # no nulls
    mf = Q.model_frame(spark, sf)
    lrn = learner("gbt_leafwise", patience=2, stepSize=0.4, subsamplingRate=1.0, featureSubsetStrategy="all")
    res = runs.run_cv(mf, feats, lrn)
    oof = res.oof().toPandas().set_index("id").sort_index()
    assert set(res.best_iters) == set(range(5)) and len(res.importances) == 5 * len(feats)
    f = 0
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    x = mf.select("id", "is_train", "fold", F.col("target").alias("label"), *[F.col(c).cast("double") for c in feats])
    m = learner("gbt_leafwise", maxIter=res.best_iters[f], stepSize=0.4, subsamplingRate=1.0,
                featureSubsetStrategy="all").estimator(42).fit(asm.transform(x.where(f"is_train and fold != {f}")))
    pr = m.transform(asm.transform(x.where(f"is_train and fold = {f}"))).select("id", "prediction").toPandas()
    pr = pr.set_index("id").sort_index()
    assert np.allclose(pr.prediction.values, oof.loc[pr.index, "pred"].values, atol=1e-12)


def test_boosting_goes_on_until_patience_ends(spark, sf):
    """The number of rounds grows beyond its start; the best is followed by ``patience`` worse rounds."""
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    mf = Q.model_frame(spark, sf)
    res = runs.run_cv(mf, ["age", "steps", "bmi"], learner("gbt_hist", patience=3, stepSize=0.1, maxDepth=2), k=5)
    assert max(res.best_iters.values()) > 8
    capped = runs.run_cv(mf, ["age", "steps", "bmi"], learner("gbt_hist", patience=3, max_rounds=4, stepSize=0.1, maxDepth=2))
    assert max(capped.best_iters.values()) <= 4


def test_log_target_averages_before_inverting(spark):
    """Fold predictions are averaged on the log scale, then brought back."""
    from foldspark.plans import runs
    preds = spark.createDataFrame([("e", 1, f, "test", float(v)) for f, v in enumerate([0.1, 1.2, 2.0])]
                                  + [("e", 2, 0, "oof", 0.7)], "experiment string, id long, fold int, split string, pred double")
    res = runs.CVResult("e", preds, inverse=F.expm1)
    assert res.test_mean().first().pred == pytest.approx(np.expm1(np.mean([0.1, 1.2, 2.0])))
    assert res.oof().first().pred == pytest.approx(np.expm1(0.7))


def test_last_parameters_are_the_last_saved(spark, tmp_path):
    path = str(tmp_path / "params")
    for v in range(6):
        store.save_params(spark, path, "m", {"v": v})
    store.save_params(spark, path, "other", {"v": 99})
    assert store.load_params(spark, path, "m") == {"v": 5.0} and store.load_params(spark, path, "none") == {}


def test_submission_without_a_prediction_fails(spark, tmp_path):
    preds = spark.createDataFrame([(1, 2.0)], "id long, pred double")
    with pytest.raises(Exception, match="no prediction for id 2"):
        store.save_submission(preds, str(tmp_path / "s"), "y", order_from=spark.createDataFrame([(1,), (2,)], "id long"))


def test_csv_numbers_as_text(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("id,x,c\n34.0,1e3, NA \n7, 2.5 ,x\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("c", T.StringType())])
    assert [tuple(r) for r in CSV.read_csv(spark, str(p), schema).collect()] == [(34, 1000.0, " NA "), (7, 2.5, "x")]
    for bad in ("1.5,1,a", "1,12abc,a"):
        p.write_text(f"id,x,c\n{bad}\n")
        with pytest.raises(Exception, match="cannot read"):
            CSV.read_csv(spark, str(p), schema).collect()
        assert None in tuple(CSV.read_csv(spark, str(p), schema, malformed="null").first())


def test_zero_divisors_give_null(spark):
    from foldspark.operators import blend as B, calibrate as C, metrics as M
    same = spark.createDataFrame([(1, 2.0, 1.0, 0), (2, 2.0, 1.0, 1)], "id long, target double, pred double, fold int")
    assert M.r2(same).first().r2 is None
    assert M.target_moments(same).first().skew is None
    assert same.agg(B.optimal_weight_2("pred", "pred").alias("w")).first().w == 0.5
    one = same.limit(1).withColumn("is_train", F.lit(True))
    assert C.calibrate_quadratic(one, k=2).first().calibrated is None


def test_blend_keeps_nulls(spark):
    from foldspark.operators import blend as B
    rows = [(1, "a", 4.0), (1, "b", None), (2, "a", 4.0), (3, "a", 4.0), (3, "b", 8.0)]
    long = spark.createDataFrame(rows, "id long, model string, pred double")
    assert {r.id: r.blend for r in B.weighted_mean_long(long).collect()} == {1: None, 2: None, 3: 6.0}
    assert {r.id: r.blend for r in B.weighted_mean_long(long, {"a": 3, "b": 1}).collect()} == {1: None, 2: None, 3: 5.0}
    assert {r.id: r.blend for r in B.weighted_mean_long(long, {"a": 1}).collect()} == {1: 4.0, 2: 4.0, 3: 4.0}
    assert {r.blend for r in B.weighted_mean_long(long, {"a": 0.0}).collect()} == {None}


def test_load_and_clean_train_test(spark, tmp_path):
    tr = tmp_path / "train.csv"
    te = tmp_path / "test.csv"
    tr.write_text("id,country,x,target\n1,Spain,1.5,3.0\n2,NA,nan,4.0\n")
    te.write_text("id,country,x\n3,Sweden,2.0\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("country", T.StringType()),
                           T.StructField("x", T.DoubleType()), T.StructField("target", T.DoubleType())])
    from foldspark.operators.clean import COUNTRY_ALIASES
    df = CSV.load_and_clean(spark, str(tr), str(te), schema, "target", "country", COUNTRY_ALIASES)
    rows = {r.id: r for r in df.collect()}
    assert rows[1].country == "Ispanya" and rows[1].is_train and rows[1].target == 3.0
    assert rows[2].country is None and rows[2].x is None
    assert rows[3].country == "Isvec" and not rows[3].is_train and rows[3].target is None


def test_category_runner_is_leak_safe(spark, sf):
    """M3: fold f's predictions do not move when the targets of fold f's rows change
    (neither the fit nor the fold-internal encodings see them)."""
    from foldspark.plans import fixtures as FX
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    mf = Q.model_frame(spark, sf)
    lrn = replace(learner("gbt_depthwise", maxIter=5), patience=None)     # no early stop: it looks at the fold
    num = ["age", "stress", "bmi", "steps"]
    a = runs.run_cv_encoded(mf, num, FX.PANEL_CATEGORIES, lrn).oof().toPandas().set_index("id").sort_index()
    shifted = mf.withColumn("target", F.when(F.col("is_train") & (F.col("fold") == 2), F.col("target") + 3.0)
                            .otherwise(F.col("target")))
    b = runs.run_cv_encoded(shifted, num, FX.PANEL_CATEGORIES, lrn).oof().toPandas().set_index("id").sort_index()
    f2 = a.fold == 2
    assert np.allclose(a.pred[f2].values, b.pred[f2].values, atol=1e-12)
    assert not np.allclose(a.pred[~f2].values, b.pred[~f2].values)


def test_kfold_runner_is_leak_safe(spark, sf):
    """Fold f's out-of-fold predictions ignore fold f's targets."""
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    mf = Q.model_frame(spark, sf)
    lrn = learner("forest", numTrees=5, maxDepth=4)
    a = runs.run_cv(mf, Q.FEATURES, lrn).oof().toPandas().set_index("id").sort_index()
    shifted = mf.withColumn("target", F.when(F.col("is_train") & (F.col("fold") == 1), F.col("target") * 0.5)
                            .otherwise(F.col("target")))
    b = runs.run_cv(shifted, Q.FEATURES, lrn).oof().toPandas().set_index("id").sort_index()
    f1 = a.fold == 1
    assert np.allclose(a.pred[f1].values, b.pred[f1].values, atol=1e-12)
    assert not np.allclose(a.pred[~f1].values, b.pred[~f1].values)


# ---- boosting on, run matrix, search, imputation, CSV by name -----------------------------------

def _boost_rows(spark, n=400, seed=4):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(0, 0.2, n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.mark.parametrize("cut", [25, 3])
def test_boosting_on_equals_one_long_run(spark, monkeypatch, cut):
    """Tree by tree on the residual gives MLlib's own ensemble, also when the residual is stored on the way."""
    from pyspark.ml.regression import GBTRegressor
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    monkeypatch.setattr(runs, "RESIDUAL_ROUNDS", cut)
    rows = _boost_rows(spark)
    fit, valid = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    fitted = []
    forest = runs.RandomForestRegressor.fit

    def counted(self, *a, **kw):
        fitted.append(1)
        return forest(self, *a, **kw)

    monkeypatch.setattr(runs.RandomForestRegressor, "fit", counted)
    lrn = learner("gbt_leafwise", patience=40, max_rounds=9, stepSize=0.2, maxDepth=3, minInstancesPerNode=2,
                  subsamplingRate=1.0, featureSubsetStrategy="all")
    model, best = runs.boost(lrn, 7, fit, valid, {})
    assert len(fitted) == 9 and best <= 9
    long = GBTRegressor(maxIter=best, stepSize=0.2, maxDepth=3, minInstancesPerNode=2, seed=7).fit(fit)
    got = model.transform(valid).toPandas().sort_values("id").prediction.values
    assert np.allclose(got, long.transform(valid).toPandas().sort_values("id").prediction.values, atol=1e-9)
    losses = long.evaluateEachIteration(valid, "squared")
    assert int(np.argmin(losses)) + 1 == best and model.getNumTrees == best
    assert np.allclose(model.featureImportances.toArray(), long.featureImportances.toArray(), atol=1e-9)


def test_run_matrix_goes_on_where_it_stopped(spark, sf, tmp_path, monkeypatch):
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    p = Q.model_frame(spark, sf)
    two = {"r1": learner("ridge"), "r2": learner("ridge", maxIter=50)}
    path = str(tmp_path / "m")
    real, seen = runs._fit_fold, []

    def failing(f, *a, **kw):
        if len(seen) == 5:
            raise RuntimeError("executor lost")
        seen.append(f)
        return real(f, *a, **kw)

    monkeypatch.setattr(runs, "_fit_fold", failing)
    with pytest.raises(RuntimeError):
        runs.run_matrix(p, ["age", "steps"], two, path, seeds=(1, 2), k=3, parallel=1)
    monkeypatch.setattr(runs, "_fit_fold", real)
    res = runs.run_matrix(p, ["age", "steps"], two, path, seeds=(1, 2), k=3)
    assert len(res.fitted) == 12 - 5
    assert runs.run_matrix(p, ["age", "steps"], two, path, seeds=(1, 2), k=3).fitted == []
    n_train, n_test = p.where("is_train").count(), p.where("not is_train").count()
    counts = {(r.model, r.split): r["count"] for r in res.predictions().groupBy("model", "split").count().collect()}
    assert counts == {(m, s): n for m in two for s, n in (("oof", 2 * n_train), ("test", 6 * n_test))}
    out, coef, _ = res.stacked(p.where("is_train"))
    assert out.count() == n_train + n_test and out.where("pred is null or r1 is null").count() == 0 and (coef >= 0).all()


def test_matrix_trains_on_extra_rows(spark, tmp_path):
    """M12 in the matrix: pseudo rows train every fold's model and are never scored."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(90), "x": rng.normal(size=90), "is_train": np.arange(90) < 60})
    pdf["target"] = pdf.x
    df = spark.createDataFrame(pdf)
    extra = df.where("not is_train").select("id", F.lit(50.0).alias("label"), "x")
    a = runs.run_matrix(df, ["x"], {"r": learner("ridge")}, str(tmp_path / "a"), seeds=(1,), k=3)
    b = runs.run_matrix(df, ["x"], {"r": learner("ridge")}, str(tmp_path / "b"), seeds=(1,), k=3, extra_train=extra)
    assert b.predictions().count() == a.predictions().count()
    assert b.predictions().agg(F.avg("pred")).first()[0] > a.predictions().agg(F.avg("pred")).first()[0] + 5


def test_search_stops_hopeless_trials(spark, sf, tmp_path):
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    p = Q.model_frame(spark, sf)
    space = runs.Space({"regParam": ("logfloat", 1e-3, 1e3), "maxIter": ("logint", 5, 50)})
    base = replace(learner("ridge"), ridge_alpha=None, scale=False)
    path = str(tmp_path / "s")
    trials, best, final = runs.random_search(p, ["age", "stress", "steps"], base, space, 6, first_folds=2, keep=0.34,
                                             refit=base, path=path)
    t = trials.orderBy("trial").collect()
    assert sorted(r.n_folds for r in t) == [2, 2, 2, 5, 5, 5] or sorted(r.n_folds for r in t) == [2, 2, 2, 2, 5, 5]
    assert {r.complete for r in t if r.n_folds == 5} == {True}
    whole, best2, _ = runs.random_search(p, ["age", "stress", "steps"], base, space, 6)
    w = whole.orderBy("trial").collect()
    assert all(r.complete for r in w) and [r.params for r in w] == [r.params for r in t]
    win = min(w, key=lambda r: (r.cv_rmse, r.trial))
    assert best2 == {"regParam": win.params["regParam"], "maxIter": int(win.params["maxIter"])}
    assert store.load_params(spark, f"{path}/params", "ridge") == pytest.approx({k: float(v) for k, v in best.items()})
    assert store.read_experiment_log(spark, f"{path}/log").first().cv_rmse == pytest.approx(
        final.scores(p).first().mean_fold_rmse)
    for s in runs.SPACES.values():
        got = s.sample(__import__("random").Random(1))
        assert set(got) == set(s.dims) and all(isinstance(got[k], str) for k, d in s.dims.items() if d[0] == "fraction")


def test_imputation_order_learner_and_empty_columns(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    from foldspark.plans import runs
    rows = [(i, float(i % 10), None if i % 3 == 0 else float(i % 10) * 2, None if i % 5 == 0 else 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, never double")
    out = runs.impute_chained(df, ["a", "b", "c", "never"], 2, make_estimator=lambda: DecisionTreeRegressor(
        featuresCol="features", labelCol="__label", predictionCol="__p", maxDepth=6))
    got = out.toPandas().set_index("id").sort_index()
    assert list(out.columns) == ["id", "a", "b", "c"]
    assert np.allclose(got.b.values, [i % 10 * 2 for i in range(60)]) and (got.c == 1.0).all()
    assert runs.impute_chained(df.where("id < 0"), ["a", "b"]).count() == 0


def test_wide_refuses_two_predictions_of_a_row(spark):
    from foldspark.operators import blend as B
    rows = [(1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (3, "z", 9.0)]
    long = spark.createDataFrame(rows, "id int, model string, pred double")
    assert sorted(map(tuple, B.wide(long, ["a", "b"]).collect())) == [(1, 1.0, None), (2, 3.0, None), (3, None, None)]
    with pytest.raises(Exception, match="two predictions of one row by model a"):
        B.wide(long.unionByName(long), ["a", "b"]).collect()


def test_moments_of_many_columns(spark):
    from foldspark.operators import blend as B
    rng = np.random.default_rng(6)
    x = rng.normal(1000, 1, size=(500, 76))
    names = [f"m{i}" for i in range(75)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[*names, "target"])).repartition(7)
    df = df.unionByName(df.limit(1).withColumn("m3", F.lit(None).cast("double")))
    r = x[:, 75:] - x[:, :75]
    assert np.allclose(B.residual_moments(df, names), r.T @ r / 500, atol=1e-9)
    g, b, m, my, n = B.centred_moments(df, names)
    c = x - x.mean(0)
    assert n == 500 and np.allclose(g, c[:, :75].T @ c[:, :75], atol=1e-7) and np.allclose(b, c[:, :75].T @ c[:, 75], atol=1e-7)
    few = names[:4]
    plain = B.residual_moments(df, few)
    assert np.allclose(plain, B.residual_moments(df, names)[:4, :4], atol=1e-9)
    w = B.optimal_weights(df, names)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)


def test_csv_binds_by_name(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("stress", T.DoubleType()),
                           T.StructField("bmi", T.DoubleType()), T.StructField("note", T.StringType())])
    p = tmp_path / "a.csv"
    p.write_text('bmi,id,note,extra,stress\n1,2,"a\nb ""c""",x,3\n4,5,,y,NA\n')
    assert [tuple(r) for r in CSV.read_csv(spark, str(p), schema).collect()] == [(2, 3.0, 1.0, 'a\nb "c"'), (5, None, 4.0, None)]
    p.write_text("id,stress,bmi\n1,2,3\n")
    with pytest.raises(ValueError, match="no column note"):
        CSV.read_csv(spark, str(p), schema)
    d = tmp_path / "two"
    d.mkdir()
    (d / "1.csv").write_text("id,stress,bmi,note\n1,2,3,a\n" * 1)
    (d / "2.csv").write_text("stress,id,bmi,note\n1,2,3,a\n")
    with pytest.raises(Exception):
        CSV.read_csv(spark, str(d), schema).collect()


def test_csv_quarantine(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType())])
    p = tmp_path / "q.csv"
    p.write_text("x,id\n1.5,1\nabc,2\n2,3,4\nNaN,4\n2,5.5\n")
    good, bad = CSV.read_csv_quarantined(spark, str(p), schema)
    assert sorted(map(tuple, good.collect())) == [(1, 1.5), (4, None)]
    assert sorted((r.reason, "abc" in r.record or "5.5" in r.record or "2,3,4" in r.record) for r in bad.collect()) == [
        ("column id", True), ("column x", True), ("fields", True)]
    with pytest.raises(Exception, match="cannot read"):
        CSV.read_csv(spark, str(p), schema).collect()
    assert CSV.read_csv(spark, str(p), schema, malformed="null").count() == 5


def test_class_without_rows_has_no_probability(spark):
    from foldspark.plans import runs
    from foldspark.plans.models import quick
    rows = _boost_rows(spark).withColumn("label", F.when(F.col("label") > 1, 3.0).otherwise(0.0))
    lrn = replace(quick("class_boost", maxIter=2), classes=5)
    got = runs.one_vs_rest(lrn, 1, rows, rows).select("label", "probability").toPandas()
    p = np.array(got.probability.tolist())
    assert np.allclose(p.sum(1), 1) and (p[:, [1, 2, 4]] == 0).all()
    assert ((p[:, 3] > 0.5) == (got.label == 3)).mean() > 0.9
    one = rows.withColumn("label", F.lit(2.0))
    assert np.array(runs.one_vs_rest(lrn, 1, one, one).toPandas().probability.tolist())[:, 2].min() == 1.0


def test_imputation_joins_nothing(spark, monkeypatch):
    """Gaps follow from the models so far; no table of cells is joined (or sent through the driver), whatever the
    number of models that one plan holds."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    from foldspark.plans import runs
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) + 5
    x[:, 1] += x[:, 0]
    pdf = pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a"))).withColumn(
        "b", F.when(F.col("id") % 3 > 0, F.col("b")))

    def refused(*a, **k):
        raise AssertionError("join")

    monkeypatch.setattr(Classic, "join", refused)
    want = runs.impute_chained(df, ["b", "a", "c"], rounds=3).toPandas().sort_values("id").reset_index(drop=True)
    monkeypatch.setattr(runs, "CHAIN", 1)
    got = runs.impute_chained(df, ["b", "a", "c"], rounds=3).toPandas().sort_values("id").reset_index(drop=True)
    assert list(want.columns) == ["id", "b", "a", "c"] and np.allclose(want, got, atol=1e-9)
    a, b, c = (pdf[n].to_numpy(copy=True) for n in "abc")
    ga, gb = (pdf.id % 5 == 0).values, (pdf.id % 3 == 0).values
    a[ga], b[gb] = a[~ga].mean(), b[~gb].mean()
    for _ in range(3):
        for y, other, gap in ((a, b, ga), (b, a, gb)):
            m = np.column_stack([np.ones(300), other, c])
            y[gap] = m[gap] @ np.linalg.lstsq(m[~gap], y[~gap], rcond=None)[0]
    assert np.allclose(got.a, a, atol=1e-6) and np.allclose(got.b, b, atol=1e-6)


def test_fits_side_by_side_follow_the_memory(spark):
    """Few rows: all at once; rows beyond the executors' memory: one after the other."""
    from foldspark.plans import runs
    assert runs.abreast(spark, 1000, 40, 11) == 11 and runs.abreast(spark, 0, 0, 5) == 5
    assert runs.abreast(spark, 10 ** 10, 40, 11) == 1


def test_wide_shuffles_an_id_once(spark):
    """One shuffle, after the rows of an id that one task holds have become one."""
    from foldspark.operators import blend as B
    long = spark.range(100).selectExpr("id", "explode(array('a', 'b', 'c')) as model").withColumn("pred", F.col("id") * 1.5)
    w = B.wide(long.where("model <> 'c' or id > 2"), ["a", "b", "c"])
    assert w._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") + w._jdf.queryExecution().executedPlan().toString().count(
        "Exchange hashpartitioning") <= 3
    assert {tuple(r) for r in w.where("id < 4").collect()} == {(i, i * 1.5, i * 1.5, i * 1.5 if i > 2 else None) for i in range(4)}


def test_a_round_applies_the_newest_tree_only(spark, monkeypatch):
    """Rows carry what the trees so far leave over, so a round's work does not grow with the rounds."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rows, sizes = _boost_rows(spark), []
    real = runs.ensemble

    def seen(trees, weights):
        sizes.append(len(trees))
        return real(trees, weights)

    monkeypatch.setattr(runs, "ensemble", seen)
    monkeypatch.setattr(runs, "RESIDUAL_ROUNDS", 4)
    lrn = learner("gbt_leafwise", patience=2, max_rounds=8, stepSize=0.1, maxDepth=3, minInstancesPerNode=2,
                  subsamplingRate=1.0, featureSubsetStrategy="all")
    model, best = runs.boost(lrn, 7, rows, rows, {})
    assert best == model.getNumTrees == sizes[-1] == 8 and max(sizes[:-1]) == 2


def test_averages_are_taken_after_the_shuffle(spark, tmp_path):
    """No sums are held per row read before the shuffle; the means stay."""
    from foldspark.plans import runs
    rows = [(i, "oof" if i % 2 else "test", i + s + f / 10, s, m, f) for i in range(20) for s in (1, 2) for m in ("a", "b")
            for f in ((0,) if i % 2 else (0, 1))]
    spark.createDataFrame(rows, "id long, split string, pred double, seed int, model string, fold int").write.partitionBy(
        "seed", "model", "fold").parquet(str(tmp_path / "m" / "predictions"))
    out = runs.MatrixResult(spark, str(tmp_path / "m"), ["a", "b"], []).averaged()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange")
    got = {(r.id, r.split, r.model): (round(r.pred, 9), r.n_avg) for r in out.collect()}
    assert got == {(i, "oof" if i % 2 else "test", m): ((i + 1.5, 2) if i % 2 else (i + 1.55, 4)) for i in range(20) for m in ("a", "b")}


@pytest.mark.parametrize("rounds, most, patience", [(6, 12, 40), (6, 5, 40), (24, 500, 2)])
def test_many_rows_start_with_one_long_run(spark, monkeypatch, rounds, most, patience):
    """From ``LONG_RUN_ROWS`` rows on the first rounds are one MLlib run that bins the rows once; trees, losses and
    the stop are those of boosting tree by tree, whether that ends within the run or beyond it."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rows = _boost_rows(spark)
    fit, valid = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    lrn = learner("gbt_leafwise", patience=patience, max_rounds=most, stepSize=0.4, maxDepth=3, minInstancesPerNode=2,
                  subsamplingRate=1.0, featureSubsetStrategy="all")
    want, best = runs.boost(lrn, 7, fit, valid, {})
    fitted = {"forest": 0, "gbt": 0}

    def counted(cls, name):
        real = cls.fit

        def call(self, *a, **kw):
            fitted[name] += 1
            return real(self, *a, **kw)
        monkeypatch.setattr(cls, "fit", call)

    counted(runs.RandomForestRegressor, "forest")
    from pyspark.ml.regression import GBTRegressor
    counted(GBTRegressor, "gbt")
    monkeypatch.setattr(runs, "LONG_RUN_ROWS", 300)
    monkeypatch.setattr(runs, "LONG_RUN_ROUNDS", rounds)
    got, again = runs.boost(lrn, 7, fit, valid, {})
    first = min(most, max(1, rounds * 2 // max(2, min(patience, 10))) * max(2, min(patience, 10)))
    assert fitted == {"forest": most - first if patience == 40 else 0, "gbt": 1}
    assert again == best == got.getNumTrees
    a, b = (m.transform(valid).toPandas().sort_values("id").prediction.values for m in (want, got))
    assert np.allclose(a, b, atol=1e-9)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)


@pytest.mark.parametrize("rounds, most, patience", [(1, 500, 2), (5, 16, 40)])
def test_a_run_without_a_stop_is_followed_by_a_longer_one(spark, monkeypatch, rounds, most, patience):
    """On many rows no tree beyond the first run is fitted on its own, unless few are left; model and stop stay."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rows = _boost_rows(spark)
    fit, valid = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    lrn = learner("gbt_leafwise", patience=patience, max_rounds=most, stepSize=0.4, maxDepth=3, minInstancesPerNode=2,
                  subsamplingRate=1.0, featureSubsetStrategy="all")
    want, best = runs.boost(lrn, 7, fit, valid, {})
    lengths, alone = [], []
    gbt, forest = runs.GBTRegressor.fit, runs.RandomForestRegressor.fit
    monkeypatch.setattr(runs.GBTRegressor, "fit", lambda self, *a: lengths.append(self.getMaxIter()) or gbt(self, *a))
    monkeypatch.setattr(runs.RandomForestRegressor, "fit", lambda self, *a: alone.append(1) or forest(self, *a))
    monkeypatch.setattr(runs, "LONG_RUN_ROWS", 300)
    monkeypatch.setattr(runs, "LONG_RUN_ROUNDS", rounds)
    got, again = runs.boost(lrn, 7, fit, valid, {})
    assert not alone and len(lengths) > 1 and lengths == [min(most, lengths[0] * 2 ** i) for i in range(len(lengths))]
    assert again == best == got.getNumTrees
    a, b = (m.transform(valid).toPandas().sort_values("id").prediction.values for m in (want, got))
    assert np.allclose(a, b, atol=1e-9)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)


def test_matrix_learners_are_whole():
    """The run matrix boosts with the source's settings, not a few rounds of shallow trees."""
    from foldspark.plans import q_models as Q
    from foldspark.plans.models import LEARNERS
    assert Q.MATRIX == {n: LEARNERS[n] for n in ("gbt_leafwise", "gbt_depthwise", "gbt_hist")}


def test_long_patience_is_one_run(spark, monkeypatch):
    """Where the patience makes many rounds certain, few rows too are binned once; model and stop are those of tree by tree."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rows = _boost_rows(spark)
    fit, valid = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    lrn = learner("gbt_leafwise", patience=6, max_rounds=30, stepSize=0.4, maxDepth=3, minInstancesPerNode=2,
                  subsamplingRate=1.0, featureSubsetStrategy="all")
    want, best = runs.boost(lrn, 7, fit, valid, {})
    alone, forest = [], runs.RandomForestRegressor.fit
    monkeypatch.setattr(runs.RandomForestRegressor, "fit", lambda self, *a: alone.append(1) or forest(self, *a))
    monkeypatch.setattr(runs, "LONG_PATIENCE", 5)
    got, again = runs.boost(lrn, 7, fit, valid, {})
    assert not alone and again == best == got.getNumTrees
    a, b = (m.transform(valid).toPandas().sort_values("id").prediction.values for m in (want, got))
    assert np.allclose(a, b, atol=1e-9)


def test_a_fitted_tree_outlives_the_release_of_its_model(spark, monkeypatch):
    """The model whose trees are taken is still named then, so the JVM cannot drop it before."""
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    forest, early = runs.RandomForestRegressor.fit, []

    def watched(self, *a):
        model = forest(self, *a)

        class Held:
            def __init__(self):
                self.gone = False

            @property
            def _java_obj(self):
                held = self

                class Java:
                    def trees(self):
                        early.append(held_ref() is None)
                        return model._java_obj.trees()
                import weakref
                held_ref = weakref.ref(held)
                del held
                return Java()
        return Held()

    monkeypatch.setattr(runs.RandomForestRegressor, "fit", watched)
    runs.boost(learner("gbt_leafwise", patience=1, max_rounds=2, maxDepth=2), 7, _boost_rows(spark), _boost_rows(spark), {})
    assert early and not any(early)


def test_search_query_is_whole(spark, sf, monkeypatch):
    """The query hands the source's ranges, rounds and patience to every trial and leaves none after its first folds."""
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import LEARNERS
    asked = {}

    class Asked(Exception):
        pass

    def search(df, features, base, space, n_trials=40, seed=42, refit=None, first_folds=None, **kw):
        asked.update(base=base, space=space, n=n_trials, refit=refit, first=first_folds)
        raise Asked

    monkeypatch.setattr(runs, "random_search", search)
    with pytest.raises(Asked):
        Q.q_random_search(spark, sf)
    assert asked["base"] == replace(LEARNERS["gbt_leafwise"], patience=100, max_rounds=3000)
    assert asked["refit"] == LEARNERS["gbt_leafwise"] and asked["space"] is runs.SPACES["gbt_leafwise"]
    assert asked["n"] == 40 and asked["first"] is None


def test_search_saves_shares_written_as_text(spark, sf, tmp_path):
    """A share sampled as text is a number in the trial table and in the saved parameters."""
    from foldspark.plans import q_models as Q, runs
    from foldspark.plans.models import learner
    space = runs.Space({"featureSubsetStrategy": ("fraction", 0.5, 1.0), "maxDepth": ("int", 1, 2)})
    path = str(tmp_path / "s")
    trials, best, final = runs.random_search(Q.model_frame(spark, sf), ["age", "steps"], learner("gbt_leafwise", patience=1, max_rounds=2),
                                             space, 2, refit=learner("gbt_leafwise", patience=1, max_rounds=2), path=path)
    assert store.load_params(spark, f"{path}/params", "gbt_leafwise") == {k: float(v) for k, v in best.items()}
    assert trials.where("n_folds = 5").count() == 2 and final.oof().count() > 0


def test_a_middling_table_is_binned_once(spark, monkeypatch):
    """No fit a tree from 50,000 rows on."""
    from pyspark.ml.feature import VectorAssembler
    from foldspark.plans import runs
    from foldspark.plans.models import learner
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(50000).selectExpr("double(id % 97) as x", "double(id % 97) * 2 as label"))
    alone, forest = [], runs.RandomForestRegressor.fit
    monkeypatch.setattr(runs.RandomForestRegressor, "fit", lambda self, *a: alone.append(1) or forest(self, *a))
    model, best = runs.boost(learner("meta_gbt", patience=1, max_rounds=2), 7, rows, rows, {})
    assert not alone and best == model.getNumTrees == 2


def test_imputation_keeps_rows_between_models(spark):
    """A fit reads rows that are kept since the model before, not the chain of all models; none stay kept at the end."""
    from pyspark.ml.regression import LinearRegression
    from foldspark.plans import runs
    plans = []

    class Seen(LinearRegression):
        def fit(self, rows, params=None):
            plans.append(rows._jdf.queryExecution().withCachedData().toString())
            return super().fit(rows, params)

    rows = [(i, float(i % 7), None if i % 3 == 0 else i % 7 * 2.0, None if i % 5 == 0 else i % 4 * 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = runs.impute_chained(df, ["a", "b", "c"], 2, make_estimator=lambda: Seen(
        featuresCol="features", labelCol="__label", predictionCol="__p", solver="normal"))
    assert ["InMemoryRelation" in p for p in plans] == [False, True, True, True]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert out.count() == 60 and out.where("b is null or c is null").count() == 0


def test_imputation_of_repeated_ids_keeps_no_shuffled_rows(spark):
    """Where ids repeat, every model needs a shuffle; kept rows behind each would double the plan's text with every model."""
    from pyspark.ml.regression import LinearRegression
    from foldspark.plans import runs
    plans = []

    class Seen(LinearRegression):
        def fit(self, rows, params=None):
            plans.append(rows._jdf.queryExecution().withCachedData().toString())
            return super().fit(rows, params)

    rows = [(i // 2, float(i % 7), None if i % 3 == 0 else i % 7 * 2.0, None if i % 5 == 0 else i % 4 * 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    out = runs.impute_chained(df, ["a", "b", "c"], 2, make_estimator=lambda: Seen(
        featuresCol="features", labelCol="__label", predictionCol="__p", solver="normal"))
    assert len(plans) == 4 and not any("InMemoryRelation" in p for p in plans)
    assert out.count() == 60 and out.where("b is null or c is null").count() == 0
