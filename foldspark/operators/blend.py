"""Blends, stacking and experiment bookkeeping.

Predictions live in a long table ``(id, model, pred, ...)`` keyed by id; blends
align models by ``id`` (never by position). Weight fitting needs only small
moment matrices: one aggregate over the rows, then a driver solve of an
``n_models x n_models`` system; the fitted blend is applied as a column
expression.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import exprs as X
from foldspark.operators import solve
from foldspark.operators.joins import attach_scalar_row


def wide(long: DataFrame, models: Sequence[str], id_cols: Sequence[str] = ("id",),
         model_col: str = "model", pred_col: str = "pred") -> DataFrame:
    """One column per model. One aggregate with a condition a model, so rows of an id that lie in one task leave it as one
    row (a pivot shuffles every prediction first). Two rows of one
    id and model are an error; a model that an id lacks is null."""
    cols = list(dict.fromkeys(models))
    own = [F.col(model_col) == F.lit(m) for m in cols]
    both = long.groupBy(*id_cols).agg(*[x.alias(f"{m}_{s}") for m, o in zip(cols, own) for s, x in (
        ("p", F.first(F.when(o, F.col(pred_col)), ignorenulls=True)), ("n", F.count_if(o)))])
    return both.select(*id_cols, *[F.when(F.col(f"`{m}_n`") > 1, F.raise_error(F.lit(f"two predictions of one row by model {m}")))
                                   .otherwise(F.col(f"`{m}_p`").cast("double")).cast("double").alias(m) for m in cols])


def weighted_mean_long(long: DataFrame, weights: Mapping[str, float] | None = None,
                       id_cols: Sequence[str] = ("id",), model_col: str = "model",
                       pred_col: str = "pred", out: str = "blend") -> DataFrame:
    """B1 on the long table: ``sum(w*p) / sum(w)`` per id; equal weights by default.
    Weights are a literal map (no join). A null prediction, or a weighted model that an
    id lacks, gives null, as does a weight sum of 0; nothing is silently re-weighted."""
    if weights:
        wm = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        w = F.coalesce(wm[F.col(model_col)], F.lit(0.0))
        models = sum(1 for v in weights.values() if v)
    else:
        w = F.lit(1.0)
        models = long.select(model_col).distinct().count()      # one row per model
    used = F.when(w != 0, F.struct(model_col))
    whole = (F.count_if((w != 0) & F.col(pred_col).isNull()) == 0) & (F.count_distinct(used) == models)
    mean = F.try_divide(F.sum(w * F.coalesce(F.col(pred_col), F.lit(0.0))), F.sum(w))
    return long.groupBy(*id_cols).agg(F.when(whole, mean).alias(out))


def weighted_sum(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """B1/B5 on a wide table: normalised weighted sum of prediction columns."""
    wts = np.ones(len(cols)) if weights is None else np.asarray(weights, dtype=float)
    wts = wts / wts.sum()
    expr = None
    for c, w in zip(cols, wts):
        term = F.lit(float(w)) * F.col(c)
        expr = term if expr is None else expr + term
    return expr


def fixed_blend(df: DataFrame, cols: Sequence[str], weights: Sequence[float], out: str = "blend",
                lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """B5 + P18 + P19: fixed weights, clip to the range, flag rows clipped."""
    raw = weighted_sum(cols, weights)
    return df.withColumn(out, X.clip(raw, lo, hi)).withColumn(
        f"{out}_clipped", X.out_of_range(raw, lo, hi).cast("int"))


def blend_with_fallback(df: DataFrame, preferred: Sequence[tuple[Sequence[str], Sequence[float]]],
                        out: str = "blend", lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """B5 with fallback: the first weight set whose columns all exist."""
    for cols, wts in preferred:
        if all(c in df.columns for c in cols):
            return fixed_blend(df, cols, wts, out, lo, hi)
    raise ValueError("no candidate blend has all its inputs")


#: Columns up to which moments are plain aggregate expressions; beyond, their number (the square) is too large.
PLAIN_COLUMNS = 8


def moments(df: DataFrame, values: Sequence[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, means, centred products)`` of columns over the rows where none is null.

    Each task keeps one matrix and merges batch by batch (pairwise formula for centred moments). The tasks' matrices are merged
    in a tree: by some tasks first, whose number is the root of the number of shuffle partitions, then on the driver."""
    p = len(values)
    rows = df.select(*[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)]).na.drop()

    def merged(a, b):
        (n, m, q), (n2, m2, q2) = a, b
        if not n or not n2:
            return a if n else b
        d = m2 - m
        return n + n2, m + d * (n2 / (n + n2)), q + q2 + np.outer(d, d) * (n * n2 / (n + n2))

    def out(acc):
        import pyarrow as pa
        n, m, q = acc
        return pa.RecordBatch.from_arrays([pa.array([n], type=pa.float64()), pa.array([m.tolist()], type=pa.list_(pa.float64())),
                                           pa.array([q.ravel().tolist()], type=pa.list_(pa.float64()))], ["n", "m", "q"])

    def partial(batches):
        acc = (0.0, np.zeros(p), np.zeros((p, p)))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.asarray(b.column(i)) for i in range(p)])
                m = x.mean(0)
                acc = merged(acc, (float(len(x)), m, (x - m).T @ (x - m)))
        if acc[0]:
            yield out(acc)

    def combine(batches):
        acc = (0.0, np.zeros(p), np.zeros((p, p)))
        for b in batches:
            for n, m, q in zip(*[b.column(i).to_pylist() for i in range(3)]):
                acc = merged(acc, (n, np.array(m), np.array(q).reshape(p, p)))
        if acc[0]:
            yield out(acc)

    schema = "n double, m array<double>, q array<double>"
    some = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    got = rows.mapInArrow(partial, schema).repartition(some).mapInArrow(combine, schema).collect()
    acc = (0.0, np.zeros(p), np.zeros((p, p)))
    for r in got:
        acc = merged(acc, (r["n"], np.array(r["m"]), np.array(r["q"]).reshape(p, p)))
    return int(acc[0]), acc[1], acc[2]


def residual_moments(df: DataFrame, cols: Sequence[str], y: str = "target") -> np.ndarray:
    """``C_ij = mean((y - p_i)(y - p_j))`` over the rows without nulls, in one pass (``n^2`` numbers)."""
    n = len(cols)
    if n > PLAIN_COLUMNS:
        rows, m, q = moments(df, [F.col(y) - F.col(c) for c in cols])
        return q / rows + np.outer(m, m)
    df = df.na.drop(subset=[*cols, y])
    r = [F.col(y) - F.col(c) for c in cols]
    aggs = [F.avg(r[i] * r[j]).alias(f"c_{i}_{j}") for i in range(n) for j in range(i, n)]
    row = df.agg(*aggs).first()
    C = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            C[i, j] = C[j, i] = row[f"c_{i}_{j}"]
    return C


def optimal_weights(df: DataFrame, cols: Sequence[str], y: str = "target") -> np.ndarray:
    """B2: non-negative weights summing to one with minimum RMSE."""
    return solve.simplex_qp(residual_moments(df, cols, y))


def optimal_weight_2(a: str, b: str, y: str = "target") -> Column:
    """B2 closed form for two models (aggregate expression): weight on ``a``."""
    d = F.col(a) - F.col(b)
    # equal models: any weight gives the same blend
    w = F.coalesce(F.try_divide(F.sum((F.col(y) - F.col(b)) * d), F.sum(d * d)), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def centred_moments(df: DataFrame, cols: Sequence[str], y: str = "target"):
    """Centred Gram ``Xc'Xc``, ``Xc'yc``, means and n over the rows without nulls, in one pass
    (``covar_pop`` merges co-moments, so no cancellation of raw sums)."""
    n = len(cols)
    if n > PLAIN_COLUMNS:
        rows, m, q = moments(df, [F.col(c) for c in [*cols, y]])
        return q[:n, :n], q[:n, n], m[:n], float(m[n]), rows
    df = df.na.drop(subset=[*cols, y])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.covar_pop(c, y).alias(f"b_{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    N = row["n"]
    G = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            G[i, j] = G[j, i] = row[f"g_{i}_{j}"] * N
    bvec = np.array([row[f"b_{i}"] * N for i in range(n)])
    means = np.array([row[f"m_{i}"] for i in range(n)])
    return G, bvec, means, row["my"], N


def ridge_stack(df: DataFrame, cols: Sequence[str], y: str = "target", alpha: float = 1.0,
                positive: bool = True):
    """Ridge meta-learner with intercept and non-negative coefficients.
    Returns ``(coef, intercept)``; fitted on ``df`` (in-sample, as the source)."""
    G, b, means, my, _ = centred_moments(df, cols, y)
    coef = solve.ridge(G, b, alpha, positive)
    return coef, float(my - means @ coef)


def linear_score(cols: Sequence[str], coef, intercept: float) -> Column:
    expr = F.lit(float(intercept))
    for c, w in zip(cols, coef):
        expr = expr + F.lit(float(w)) * F.col(c)
    return expr


def compare_blends(df: DataFrame, cols: Sequence[str], y: str = "target", alpha: float = 1.0) -> DataFrame:
    """RMSE of equal weights, optimal convex weights and the ridge stack,
    with weights recorded; one scoring aggregate for all three."""
    w_opt = optimal_weights(df, cols, y)
    coef, icpt = ridge_stack(df, cols, y, alpha)
    preds = {"equal": weighted_sum(cols), "optimized": weighted_sum(cols, w_opt),
             "stacked": linear_score(cols, coef, icpt)}
    row = df.agg(*[F.sqrt(F.avg((F.col(y) - e) * (F.col(y) - e))).alias(k) for k, e in preds.items()])
    weights = {"equal": [1.0 / len(cols)] * len(cols), "optimized": [float(v) for v in w_opt],
               "stacked": [float(v) for v in coef]}
    icpts = {"equal": 0.0, "optimized": 0.0, "stacked": float(icpt)}
    items = [F.struct(F.lit(k).alias("method"), F.col(k).alias("rmse"),
                      *[F.lit(weights[k][i]).alias(f"w_{c}") for i, c in enumerate(cols)],
                      F.lit(icpts[k]).alias("intercept")) for k in preds]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def best_by_score(scores: DataFrame, name: str = "model", score: str = "rmse") -> DataFrame:
    """The name with the lowest score (``min_by``)."""
    return scores.agg(F.min_by(F.col(name), F.col(score)).alias(f"best_{name}"), F.min(score).alias(f"best_{score}"))


def average_over(long: DataFrame, keys: Sequence[str], value: str = "pred", out: str = "pred") -> DataFrame:
    """Mean prediction over seeds or folds for each key."""
    return long.groupBy(*keys).agg(F.avg(value).alias(out), F.count(F.lit(1)).alias("n_avg"))


def complete_experiments(store: DataFrame, exp_col: str = "experiment", split_col: str = "split") -> DataFrame:
    """Experiments with both out-of-fold (train) and test rows."""
    return (store.groupBy(exp_col)
                 .agg(F.count_if(F.col(split_col) == "oof").alias("n_oof"),
                      F.count_if(F.col(split_col) == "test").alias("n_test"))
                 .withColumn("complete", (F.col("n_oof") > 0) & (F.col("n_test") > 0)))


def coverage_check(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Ids only in one of two prediction sets (expect 0 and 0)."""
    from foldspark.operators.joins import coverage
    return coverage(a, b, keys)


def shrink_to_mean(df: DataFrame, col: str, factor: float = 0.95, lo: float = 0.0, hi: float = 10.0,
                   out: str | None = None) -> DataFrame:
    """``(p - mean) * factor + mean`` then clip; the mean is a one-row aggregate."""
    m = df.agg(F.avg(col).alias("__mean"))
    x = attach_scalar_row(df, m)
    return x.withColumn(out or col, X.clip((F.col(col) - F.col("__mean")) * factor + F.col("__mean"), lo, hi)).drop("__mean")


def soft_round(df: DataFrame, col: str, alpha: float = 0.15, lo: float = 0.0, hi: float = 10.0,
               out: str | None = None) -> DataFrame:
    """``p*(1-a) + round_half_even(p)*a`` then clip."""
    return df.withColumn(out or col, X.clip(F.col(col) * (1 - alpha) + F.bround(F.col(col), 0) * alpha, lo, hi))
