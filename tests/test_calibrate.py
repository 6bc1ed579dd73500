import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.operators import calibrate as C
from foldspark.operators import isotonic as iso
from foldspark.operators import folds


def _data(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    y = np.clip(rng.normal(5, 2, n), 0, 10)
    x = 0.6 * y + 2 + rng.normal(0, 0.8, n)
    pdf = pd.DataFrame({"id": np.arange(n), "target": y, "pred": x, "is_train": np.arange(n) < 450})
    df = folds.hash_folds(spark.createDataFrame(pdf), 5, 42)
    df = df.withColumn("fold", F.when(F.col("is_train"), F.col("fold")))
    return df, df.toPandas().sort_values("id").reset_index(drop=True)


def _ridge_quad(x, y, alpha):
    X = np.column_stack([x, x * x])
    Xm, ym = X.mean(0), y.mean()
    w = np.linalg.solve((X - Xm).T @ (X - Xm) + alpha * np.eye(2), (X - Xm).T @ (y - ym))
    return ym - Xm @ w, w


def test_quadratic_matches_numpy_per_fold(spark):
    df, pdf = _data(spark)
    out = C.calibrate_quadratic(df).toPandas().sort_values("id").reset_index(drop=True)
    tr = pdf[pdf.is_train]
    tests = []
    for f in range(5):
        fit = tr[tr.fold != f]
        b0, w = _ridge_quad(fit.pred.values, fit.target.values, 1.0)
        va = pdf.is_train & (pdf.fold == f)
        xv = pdf.loc[va, "pred"].values
        assert np.allclose(out.loc[va, "calibrated"], np.clip(b0 + w[0] * xv + w[1] * xv * xv, 0, 10), atol=1e-9)
        xt = pdf.loc[~pdf.is_train, "pred"].values
        tests.append(b0 + w[0] * xt + w[1] * xt * xt)
    assert np.allclose(out.loc[~out.is_train, "calibrated"], np.clip(np.mean(tests, axis=0), 0, 10), atol=1e-9)


def test_bins_match_numpy_loop(spark):
    df, pdf = _data(spark, seed=1)
    out = C.calibrate_bins(df).toPandas().sort_values("id").reset_index(drop=True)
    tr = pdf[pdf.is_train]
    for f in range(5):
        fit = tr[tr.fold != f]
        bins = np.unique(np.quantile(fit.pred.values, np.linspace(0, 1, 21)))
        bi = np.digitize(fit.pred.values, bins[1:-1])
        bias = {b: (fit.target.values[bi == b] - fit.pred.values[bi == b]).mean() for b in np.unique(bi)}
        va = pdf.is_train & (pdf.fold == f)
        xv = pdf.loc[va, "pred"].values
        exp = np.clip(xv + np.array([bias.get(b, 0.0) for b in np.digitize(xv, bins[1:-1])]), 0, 10)
        assert np.allclose(out.loc[va, "calibrated"], exp, atol=1e-9)


def test_isotonic_monotone_and_fold_safe(spark):
    df, pdf = _data(spark, seed=2)
    naive = C.calibrate_isotonic(df, fold_safe=False).toPandas().sort_values("pred")
    assert (np.diff(naive.calibrated.values) >= -1e-12).all()
    safe = C.calibrate_isotonic(df).toPandas()
    assert safe.calibrated.notna().all() and safe.calibrated.between(0, 10).all()
    tr_naive = naive[naive.is_train]
    tr_safe = safe[safe.is_train]
    rm = lambda d: np.sqrt(np.mean((d.target - d.calibrated) ** 2))
    assert rm(tr_naive) <= rm(tr_safe) + 1e-9        # in-sample fit is optimistic


def test_ridge_residual_matches_numpy(spark):
    df, pdf = _data(spark, seed=3)
    rng = np.random.default_rng(9)
    extra = pd.DataFrame({"id": pdf.id, "m1": pdf.pred + rng.normal(0, 0.3, len(pdf)),
                          "m2": pdf.pred + rng.normal(0, 0.5, len(pdf))})
    df2 = df.join(spark.createDataFrame(extra), "id")
    out = C.calibrate_ridge_residual(df2, "pred", ["m1", "m2"]).toPandas().set_index("id").sort_index()
    p = pdf.merge(extra, on="id").set_index("id").sort_index()
    feats = np.column_stack([p.pred, p.m1, p.m2, p.pred ** 2, np.abs(p.pred - 5)])
    res = p.target - p.pred
    tr = p.is_train.values
    f = 2
    fit = tr & (p.fold.values != f)
    Xf, rf = feats[fit], res.values[fit]
    Xm, rm = Xf.mean(0), rf.mean()
    w = np.linalg.solve((Xf - Xm).T @ (Xf - Xm) + 2.0 * np.eye(5), (Xf - Xm).T @ (rf - rm))
    va = tr & (p.fold.values == f)
    exp = np.clip(p.pred.values[va] + (rm - Xm @ w) + feats[va] @ w, 0, 10)
    assert np.allclose(out.calibrated.values[va], exp, atol=1e-8)


def test_pseudo_union_never_validates_pseudo(spark):
    df, _ = _data(spark, seed=4)
    u = C.pseudo_union(df, "pred").toPandas()
    own = df.select("id", "fold").toPandas().set_index("id").fold
    tr = u[u.source == "train"]
    assert (tr.model_fold.values != own.loc[tr.id].values).all()
    ps = u[u.source == "pseudo"]
    assert ps.label.between(4, 7).all() and (ps.groupby("id").size() == 5).all()


def _pav(x, y):
    """Weighted PAV on unique sorted x (ties pooled), then linear interpolation."""
    order = np.argsort(x, kind="mergesort")
    xs, ys = x[order], y[order]
    ux, inv = np.unique(xs, return_inverse=True)
    wy = np.bincount(inv, weights=ys)
    w = np.bincount(inv).astype(float)
    vals, wts, cnt = [], [], []
    for v, ww in zip(wy / w, w):
        vals.append(v)
        wts.append(ww)
        cnt.append(1)
        while len(vals) > 1 and vals[-2] > vals[-1]:
            v2, w2, c2 = vals.pop(), wts.pop(), cnt.pop()
            vals[-1] = (vals[-1] * wts[-1] + v2 * w2) / (wts[-1] + w2)
            wts[-1] += w2
            cnt[-1] += c2
    fitted = np.repeat(vals, cnt)
    return lambda q: np.interp(q, ux, fitted)


def test_isotonic_matches_pav(spark):
    df, pdf = _data(spark, seed=5)
    pdf = pdf.assign(pred=np.round(pdf.pred, 2))                  # create ties
    df2 = spark.createDataFrame(pdf[["id", "target", "pred", "is_train", "fold"]])
    out = C.calibrate_isotonic(df2, fold_safe=False).toPandas().sort_values("id")
    tr = pdf[pdf.is_train]
    f = _pav(tr.pred.values, tr.target.values)
    assert np.allclose(out.calibrated.values, np.clip(f(pdf.sort_values("id").pred.values), 0, 10), atol=1e-9)


@pytest.mark.parametrize("points,shape", [(500_000, "noisy"), (500_000, "saw"), (40, "falling"), (40, "saw"), (40, "constant"),
                                          (7, "noisy"), (7, "rising"), (7, "saw"), (2, "noisy")])
def test_distributed_pooling_equals_pav(spark, monkeypatch, points, shape):
    """Pooling over many ranges gives the blocks of one range, also with as many blocks as rows."""
    monkeypatch.setattr(iso, "POINTS", points)
    rng = np.random.default_rng(8)
    n = 60 if points == 2 else 150
    x = np.sort(rng.choice(np.arange(1000), n, replace=False) / 10)
    y = {"noisy": x / 20 + rng.normal(0, 3, n), "rising": x * 0.1, "falling": -x, "constant": np.full(n, 4.0),
         "saw": -(x // 20) * 5 + x % 20}[shape]
    pts = spark.createDataFrame([(f, float(a), float(b) * 2, 2.0) for f in (0, 3) for a, b in zip(x, y)],
                                "fit int, x double, s double, n double")
    model = iso.fit_isotonic(pts)
    got = model.orderBy("fit", "lo").toPandas()
    exact = _pav(x, y)
    for f in (0, 3):
        m = got[got.fit == f]
        assert (np.diff(m.v.values) >= -1e-12).all() and (m.lo.values[1:] > m.hi.values[:-1]).all()
        if shape == "rising":
            assert len(m) == n
    asked = np.concatenate([x, x + 0.05, [-5.0, 2000.0]])
    want = spark.createDataFrame([(f, float(a)) for f in (0, 3, 9) for a in asked], "fit int, x double").distinct()
    v = iso.score_isotonic(model, want).toPandas()
    for f in (0, 3):
        part = v[v.fit == f]
        assert len(part) == len(np.unique(asked))
        assert np.allclose(part.v.values, exact(part.x.values), atol=1e-9)
    assert v[v.fit == 9].v.isna().all()


def test_isotonic_edge_rows(spark, monkeypatch):
    rows = [(1, 1.0, 0.0, True, 0), (2, 2.0, -0.0, True, 1), (3, None, 3.0, True, 0), (4, 5.0, None, True, 1),
            (5, 9.0, float("nan"), True, 0), (6, None, 1.0, False, None), (7, None, None, False, None), (7, None, 9.0, False, None)]
    df = spark.createDataFrame(rows, "id int, target double, pred double, is_train boolean, fold int")
    for points in (500_000, 1):
        monkeypatch.setattr(iso, "POINTS", points)
        got = sorted(map(tuple, C.calibrate_isotonic(df, k=2, naive_out="naive").select("id", "calibrated", "naive").collect()), key=repr)
        assert got == sorted([(1, 2.0, 1.5), (2, 1.0, 1.5), (3, 2.0, 1.5), (4, None, None), (5, None, None), (6, 1.5, 1.5),
                              (7, None, None), (7, 1.5, 1.5)], key=repr)
    none = df.where("id > 100")
    assert C.calibrate_isotonic(none, k=2).collect() == []


def test_choice_scores_the_corrections_once(spark, monkeypatch):
    """The result reads the stored scores, so the best of them is no second pass over the rows."""
    from foldspark.plans import q_calibrate as Q
    df, _ = _data(spark)
    df = df.withColumns({c: F.col("pred") + F.col("id") % d for c, d in (("p_a", 2), ("p_b", 3), ("p_c", 5))})
    monkeypatch.setattr(Q, "calib_input", lambda spark, sf: df)
    out = Q.q_calibration_choice(spark, None)
    assert out.inputFiles() and all("/calibration-scores-" in f for f in out.inputFiles())
    got = out.toPandas()
    assert sorted(got.method) == ["bins", "isotonic", "none", "quadratic", "ridge"]
    rows = df.where("is_train").toPandas()
    assert got.set_index("method").loc["none", "rmse"] == pytest.approx(((rows.target - rows.pred) ** 2).mean() ** 0.5, abs=1e-5)
