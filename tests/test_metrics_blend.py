import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foldspark.functions import quantiles as Q
from foldspark.operators import blend as B
from foldspark.operators import metrics as M
from foldspark.operators import solve


def _errs(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.uniform(0, 10, n)
    p = y + rng.normal(0, 1, n)
    return pd.DataFrame({"id": np.arange(n), "target": y, "pred": p}), spark.createDataFrame(
        pd.DataFrame({"id": np.arange(n), "target": y, "pred": p}))


def test_scores_vs_numpy(spark):
    pdf, df = _errs(spark)
    e = pdf.target - pdf.pred
    s = M.error_summary(df).first()
    assert np.isclose(s.rmse, np.sqrt(np.mean(e ** 2)))
    assert np.isclose(s.mae, np.mean(np.abs(e)))
    assert np.isclose(s.median_abs, np.median(np.abs(e)))
    assert np.isclose(s.std_err, np.std(e))
    assert s.n_big == int((np.abs(e) > 2).sum())
    q = M.error_quantiles(df).first()
    assert np.allclose([q.q50, q.q75, q.q90, q.q95, q.q99], np.quantile(np.abs(e), [.5, .75, .9, .95, .99]))
    r2 = M.r2(df).first().r2
    assert np.isclose(r2, 1 - np.sum(e ** 2) / np.sum((pdf.target - pdf.target.mean()) ** 2))


def test_histogram_matches_numpy(spark):
    pdf, df = _errs(spark, 997, 3)
    e = (pdf.target - pdf.pred).values
    h = M.histogram(df, M.err(), 80).toPandas().set_index("bin").n.reindex(range(80), fill_value=0)
    counts, _ = np.histogram(e, bins=80)
    assert (h.values == counts).all()


def test_box_whiskers(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 30.0]
    df = spark.createDataFrame([(0, v) for v in vals], "g int, v double")
    r = M.box_stats(df, F.col("g"), F.col("v")).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    hi = q3 + 1.5 * (q3 - q1)
    assert np.isclose(r.q1, q1) and np.isclose(r.med, med) and np.isclose(r.q3, q3)
    assert r.whislo == 1.0 and r.whishi == max(v for v in vals if v <= hi)


def test_target_moments_skew_bias_corrected(spark):
    pdf, df = _errs(spark)
    m = M.target_moments(df).first()
    assert np.isclose(m.skew, pdf.target.skew())
    assert np.isclose(m.std, pdf.target.std()) and np.isclose(m.std_pop, pdf.target.std(ddof=0))


def test_error_by_missing_and_category(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, None, "a"), (2, 1.0, 1.0, 2.0, "a"), (3, 3.0, 0.0, 1.0, "b")],
                               "id long, target double, pred double, x double, c string")
    r = M.error_by_missing(df, ["x", "c"]).collect()
    assert len(r) == 1 and r[0].col == "x" and r[0].mae_missing == 1.0 and r[0].mae_present == 1.5
    cat = {x.level: x.mean_abs for x in M.error_by_category(df, ["c"]).collect()}
    assert cat == {"a": 0.5, "b": 3.0}


def test_simplex_qp_vs_grid():
    rng = np.random.default_rng(4)
    for _ in range(5):
        R = rng.normal(size=(200, 3)) + rng.normal(size=3)
        C = R.T @ R / len(R)
        w = solve.simplex_qp(C)
        assert np.all(w >= -1e-12) and np.isclose(w.sum(), 1)
        best = min(((a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1, 101) if a + b <= 1),
                   key=lambda v: np.array(v) @ C @ np.array(v))
        assert w @ C @ w <= np.array(best) @ C @ np.array(best) + 1e-9


def test_nonneg_ridge_vs_support_enumeration():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(100, 4))
    y = X @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=100)
    Xc, yc = X - X.mean(0), y - y.mean()
    G, b = Xc.T @ Xc, Xc.T @ yc
    w = solve.ridge(G, b, 1.0, positive=True)
    best, bestv = None, np.inf
    for k in range(5):
        for S in itertools.combinations(range(4), k):
            z = np.zeros(4)
            if S:
                S = list(S)
                z[S] = np.linalg.solve(G[np.ix_(S, S)] + np.eye(len(S)), b[S])
                if np.any(z < 0):
                    continue
            v = z @ (G + np.eye(4)) @ z - 2 * b @ z
            if v < bestv:
                best, bestv = z, v
    assert np.allclose(w, best, atol=1e-9)


def test_blends_end_to_end(spark):
    rng = np.random.default_rng(6)
    n = 400
    y = rng.uniform(0, 10, n)
    pdf = pd.DataFrame({"id": np.arange(n), "target": y, "a": y + rng.normal(0, 1, n),
                        "b": 0.9 * y + rng.normal(0, 1.5, n), "c": y + 2 + rng.normal(0, 0.5, n)})
    df = spark.createDataFrame(pdf)
    cols = ["a", "b", "c"]
    w = B.optimal_weights(df, cols)
    assert np.all(w >= 0) and np.isclose(w.sum(), 1)
    cmp = {r.method: r.rmse for r in B.compare_blends(df, cols).collect()}
    single = min(np.sqrt(np.mean((y - pdf[c]) ** 2)) for c in cols)
    assert cmp["optimized"] <= single + 1e-9 and cmp["stacked"] <= cmp["optimized"] + 1e-9
    w2 = df.agg(B.optimal_weight_2("a", "b").alias("w")).first().w
    grid = min(np.linspace(0, 1, 2001), key=lambda t: np.mean((y - t * pdf.a - (1 - t) * pdf.b) ** 2))
    assert abs(w2 - grid) < 1e-3


def test_weighted_mean_long_and_fallback(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 1.0), (2, "b", 3.0)],
                                 "id long, model string, pred double")
    got = {r.id: r.blend for r in B.weighted_mean_long(long, {"a": 3, "b": 1}).collect()}
    assert got == {1: 2.5, 2: 1.5}
    wide = spark.createDataFrame([(1, 9.0, 12.0)], "id long, x double, y double")
    out = B.blend_with_fallback(wide, [(["x", "y", "z"], [0.45, 0.45, 0.1]), (["x", "y"], [0.6, 0.4])]).first()
    assert np.isclose(out.blend, 10.0) and out.blend_clipped == 1
    cov = B.coverage_check(long.select("id"), spark.createDataFrame([(1,), (3,)], "id long")).first()
    assert (cov.only_left, cov.only_right) == (1, 1)


def test_quantiles_equal_numpy(spark):
    """A hot value, ties, nulls, NaN, several keys and partitions, and per-fold variants."""
    r = np.random.default_rng(5)
    v = np.where(r.random(4000) < 0.4, 1.5, np.round(r.normal(0, 3, 4000), 2))
    key = np.where(r.random(4000) < 0.9, "a", "b")
    fold = r.integers(0, 3, 4000)
    rows = [(k, float(x), int(f)) for k, x, f in zip(key, v, fold)]
    rows += [("a", None, 0), ("b", float("nan"), 1), (None, 2.0, 0), (None, 4.0, 1), ("empty", None, 2), ("a", -0.0, 1)]
    df = spark.createDataFrame(rows, "key string, v double, fold int").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    t = Q.quantiles(df, ["key"], "v", qs, [F.lit(1)] + [(F.col("fold") != f).cast("int") for f in range(3)])
    got = {(x["key"], x["variant"]): [x[f"q{i}"] for i in range(len(qs))] for x in t.collect()}
    data = [x for x in rows if x[1] is not None and not np.isnan(x[1])]
    want = {(k, j): np.percentile([x for kk, x, f in data if kk == k and f != j - 1], [100 * q for q in qs])
            for k in ("a", "b", None) for j in range(4) if any(kk == k and f != j - 1 for kk, _, f in data)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert Q.quantiles(df.limit(0), ["key"], "v", qs).count() == 0


def test_no_plan_has_a_percentile_function(spark):
    _, df = _errs(spark, 200, 9)
    for out in (M.error_quantiles(df), M.error_summary(df), M.box_stats(df, F.floor("target"), F.col("pred"))):
        assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
