"""k-fold runners and multi-run drivers.

``prepare`` writes features, label and folds once as Parquet in the shared folder; every fit of a
run family (folds, seeds, learners, trials) reads that table. ``run_cv`` fits one MLlib model per
fold: a distributed job over the rows outside the fold, the folds side by side from a small thread
pool. Nulls are filled with fold-train medians (only columns that contain nulls; the medians of all
folds and seeds come from one pass). The output is a
keyed prediction table ``(experiment, id, fold, split, pred)`` on the model's scale: ``split='oof'``
for each labelled row (scored by the model that did not see it) and
``split='test'`` for each unlabelled row once per fold model. It is written too, so no
lineage of fits reaches later stages; a prepared table that ``run_cv`` made itself is deleted then.

``run_matrix`` works off seeds x learners x folds as a table of jobs, each of which ends with its
predictions in the store; started again it fits only what is missing.

``ridge_cv`` computes the k-fold ridge (M6) from per-fold sufficient statistics
instead of k MLlib fits; the MLlib learner ``ridge`` gives the same model up to
solver tolerance.
"""
from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.functions import exprs as X
from foldspark.functions import quantiles as Q
from foldspark.operators import blend, folds, foldstats, metrics as M
from foldspark.plans.models import Learner
from foldspark.session import ensure_checkpoint_dir
from foldspark.sources import store
from foldspark.sources.scratch import discard, shared_path, stored


@dataclass
class CVResult:
    experiment: str
    preds: DataFrame                      # experiment, id, fold, split, pred
    importances: list = field(default_factory=list)   # (fold, feature, importance)
    best_iters: dict = field(default_factory=dict)
    inverse: Callable[[Column], Column] = lambda c: c   # model scale -> target scale (M13)

    def oof(self) -> DataFrame:
        return self.preds.where(F.col("split") == "oof").select("id", "fold", self.inverse(F.col("pred")).alias("pred"))

    def test_mean(self) -> DataFrame:
        """Mean test prediction over the fold models, averaged on the model's
        scale and then brought back to the target's (M13)."""
        return (self.preds.where(F.col("split") == "test").groupBy("id")
                    .agg(self.inverse(F.avg("pred")).alias("pred")))

    def scored(self, df: DataFrame, target: str = "target", id_col: str = "id") -> DataFrame:
        return self.oof().join(df.select(F.col(id_col).alias("id"), F.col(target).alias("target")), "id")

    def scores(self, df: DataFrame, target: str = "target") -> DataFrame:
        """Fold RMSEs, their mean / population std and the pooled OOF RMSE."""
        return M.fold_scores(self.scored(df, target)).withColumn("experiment", F.lit(self.experiment))


def _ev(prob: Column) -> Column:
    """Expected class value ``sum_k k * p_k`` of a probability vector (M7)."""
    return _ev_array(vector_to_array(prob))


def _lit(v) -> Column:
    return F.lit(0.0 if v is None or (isinstance(v, float) and math.isnan(v)) else float(v))


def _prepare(df: DataFrame, features: Sequence[str], target: str, fold_col: str, train_col: str,
             id_col: str, label_fn) -> DataFrame:
    label = (label_fn or (lambda c: c))(F.col(target).cast("double"))
    return df.select(F.col(id_col).alias("id"), F.col(train_col).alias("__train"),
                     F.col(fold_col).cast("int").alias("__fold"),
                     label.alias("label"), *[F.col(c).cast("double").alias(c) for c in features])


@dataclass
class Prepared:
    """The stored table ``id, __train, __fold, label, features...`` that all fits of a run family read."""
    table: DataFrame
    features: list
    k: int
    need: list                            # columns with nulls among labelled rows
    fills: dict                           # seed (None: the given folds) -> {med_<column>_<fold>: median}

    def folded(self, seed: int | None = None) -> tuple[DataFrame, dict]:
        """The table under the given folds, or under the hash folds of ``seed``, and its fold-train medians."""
        if seed is None:
            return self.table, self.fills[None]
        return self.table.withColumn("__fold", _seed_fold(seed, self.k)), self.fills[seed]

    def discard(self) -> None:
        discard(self.table)


def _seed_fold(seed: int, k: int) -> Column:
    return F.when(F.col("__train"), (X.seeded_key("id", seed) % k).cast("int"))


def prepare(df: DataFrame, features: Sequence[str], *, target: str = "target", k: int = 5, fold_col: str | None = "fold",
            train_col: str = "is_train", id_col: str = "id", label_fn=None, seeds: Sequence[int] = ()) -> Prepared:
    """Write the table of a run family once and take the medians of all its folds in one pass.

    ``fold_col``: the folds of ``run_cv``; ``seeds``: further hash folds, derived when read."""
    features = list(features)
    src = df if fold_col else df.withColumn("__nofold", F.lit(None).cast("int"))
    table = stored(_prepare(src, features, target, fold_col or "__nofold", train_col, id_col, label_fn), "cv-table")
    train = table.where("__train")
    need = foldstats.columns_with_nulls(train, features)
    cuts = ([(None, F.col("__fold"))] if fold_col else []) + [(s, _seed_fold(s, k)) for s in seeds]
    fills: dict = {s: {} for s, _ in cuts}
    if need:
        t = Q.column_quantiles(train, {c: F.col(c) for c in need},
                               weights=[(c != f).cast("int") for _, c in cuts for f in range(k)])
        for r in t.collect():                           # columns x folds x seeds rows
            fills[cuts[r["variant"] // k][0]][f"med_{r['col']}_{r['variant'] % k}"] = r["q0"]
    return Prepared(table, features, k, need, fills)


def fold_moments(base: DataFrame, features: Sequence[str], meds, k: int) -> dict:
    """Fold-train moments of the median-filled features and the label (one groupBy)."""
    md = meds if isinstance(meds, dict) else meds.asDict()
    return foldstats.fold_train_moments(base, features, k, md, "__fold", "__train", label="label")


def _fit_fold(f: int, x: DataFrame, features: list, lrn: Learner, seed: int, experiment: str,
              extra: DataFrame | None, importances: list, best_iters: dict,
              moments: dict | None = None, labels: bool = False) -> DataFrame:
    """Fit on rows outside fold ``f`` (plus ``extra`` rows), score fold ``f`` and unlabelled rows.

    ``labels``: keep the label beside the prediction."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    fit = x.where(F.col("__train") & (F.col("__fold") != f)).select("id", "label", *features)
    if extra is not None:
        fit = fit.unionByName(extra.select("id", "label", *features))
    score = x.where(~F.col("__train") | (F.col("__fold") == f))
    over = {}
    if lrn.scale:
        if moments is None or extra is not None:
            m = fit.agg(*[F.avg(c).alias(f"mu_{c}") for c in features],
                        *[F.stddev_pop(c).alias(f"sd_{c}") for c in features],
                        F.stddev_samp("label").alias("__sdy"), F.count(F.lit(1)).alias("__n")).first()
            mom = {"mu": {c: m[f"mu_{c}"] for c in features}, "sd": {c: m[f"sd_{c}"] for c in features},
                   "sdy": m["__sdy"], "n": m["__n"]}
        else:
            mom = moments[f]

        def scaled(c):
            sd = mom["sd"][c] or 0.0
            return ((F.col(c) - _lit(mom["mu"][c])) / F.lit(sd if sd > 0 else 1.0)).alias(c)
        fit = fit.select("id", "label", *[scaled(c) for c in features])
        score = score.select("id", "__train", "__fold", "label", *[scaled(c) for c in features])
        if lrn.ridge_alpha is not None:
            over["regParam"] = lrn.ridge_alpha / mom["n"] * (mom["sdy"] or 1.0)
    if lrn.patience is not None and lrn.validation == "inner":
        # hash-chosen 10 % of the fit rows decide when to stop (M4)
        inner = (X.seeded_key("id", seed + 1) % 10) == 0
        valid, fit = fit.where(inner), fit.where(~inner)
    else:
        valid = score.where(F.col("__train"))
    if lrn.kind == "one_vs_rest_ev":
        prob = one_vs_rest(lrn, seed, assembler.transform(fit), assembler.transform(score), len(features))
        return prob.select(F.lit(experiment).alias("experiment"), "id", F.lit(f).alias("fold"),
                           F.when(F.col("__train"), F.lit("oof")).otherwise(F.lit("test")).alias("split"),
                           _ev_array(F.col("probability")).alias("pred"), *(["label", "probability"] if labels else []))
    if lrn.patience is None:
        model = lrn.estimator(seed, **over).fit(assembler.transform(fit))
    else:
        model, best_iters[f] = boost(lrn, seed, assembler.transform(fit), assembler.transform(valid), over)
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
        importances.extend((f, c, float(imp[i]) if i < len(imp) else 0.0) for i, c in enumerate(features))
    out = model.transform(assembler.transform(score))
    pred = _ev(F.col("probability")) if lrn.kind == "classifier_ev" else F.col("prediction")
    return out.select(F.lit(experiment).alias("experiment"), "id", F.lit(f).alias("fold"),
                      F.when(F.col("__train"), F.lit("oof")).otherwise(F.lit("test")).alias("split"),
                      pred.cast("double").alias("pred"), *(["label"] if labels else []))


def one_vs_rest(lrn: Learner, seed: int, fit: DataFrame, score: DataFrame, n_features: int = 1) -> DataFrame:
    """M7: one boosted classifier a class (the integer labels 0, 1, ... of ``lrn.classes``), fitted side by side.

    ``score`` gets ``probability``, the classes' probabilities divided by their sum. A class without rows of its own, or
    that holds all rows, needs no model: its probability is 0 or 1 before the division. ``n_features``: the length of the
    feature vectors, by which the fits side by side are counted."""
    fit = fit.select("features", "label").persist()
    counts = {int(r["label"]): r["count"] for r in fit.groupBy("label").count().collect()}
    rows = sum(counts.values())

    def one(c: int):
        if counts.get(c, 0) in (0, rows):
            return None
        return lrn.estimator(seed + c).fit(fit.withColumn("label", (F.col("label") == c).cast("double")))

    with ThreadPoolExecutor(max_workers=abreast(fit.sparkSession, rows, n_features, lrn.classes)) as pool:
        models = list(pool.map(one, range(lrn.classes)))
    fit.unpersist()
    out = score
    for c, m in enumerate(models):
        if m is None:
            out = out.withColumn(f"__p{c}", F.lit(1.0 if counts.get(c, 0) else 0.0))
            continue
        m = m.setPredictionCol("").setRawPredictionCol(f"__r{c}").setProbabilityCol(f"__v{c}")
        out = m.transform(out).withColumn(f"__p{c}", vector_to_array(F.col(f"__v{c}"))[1]).drop(f"__r{c}", f"__v{c}")
    total = sum((F.col(f"__p{c}") for c in range(lrn.classes)), F.lit(0.0))
    names = [f"__p{c}" for c in range(lrn.classes)]
    return out.withColumn("probability", F.array(*[F.try_divide(F.col(n), total) for n in names])).drop(*names)


def abreast(spark: SparkSession, rows: int, features: int, wanted: int) -> int:
    """How many of ``wanted`` tree fits run side by side, so that the binned rows that each keeps fit half the memory that
    the executors have for stored data. The others follow; results do not depend on it."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    memory = 0
    while status.hasNext():
        memory += status.next()._1()
    return max(1, min(wanted, int(memory / 2 / max(1, rows * (4 * features + 200)))))


def _ev_array(prob: Column) -> Column:
    return F.aggregate(F.transform(prob, lambda p, i: p * i), F.lit(0.0), lambda acc, v: acc + v)


#: Rounds after which what the trees have left over is written, so that no plan is longer than that.
RESIDUAL_ROUNDS = 25

#: Fit rows from which the first rounds are one MLlib run, and how many rounds that run has (twice as many at a patience above 1).
LONG_RUN_ROWS, LONG_RUN_ROUNDS = 50_000, 48

#: Patience from which the first rounds are one MLlib run whatever the rows: more rounds than it are certain; the run has twice as many.
LONG_PATIENCE = 50

#: A tree fitted on its own takes at least as long as so many trees of a run (README).
TREE_ALONE = 3


def boost(lrn: Learner, seed: int, fit: DataFrame, valid: DataFrame, over: dict):
    """Boost until the validation loss has not improved for ``patience`` rounds, and cut.

    One tree a round is fitted on what the trees before it left over (twice the residual, as MLlib's
    squared loss has it; the first on the label), so no tree is fitted twice however long it
    goes on, and the trees are those of one long MLlib run with these settings. The residual is carried on as the rows'
    label: a round applies the newest tree to rows kept from the round before, so its time does not grow with the
    rounds. Losses are read once for several rounds. Every ``RESIDUAL_ROUNDS`` rounds the residual is stored.
    From ``LONG_RUN_ROWS`` fit rows or a patience of ``LONG_PATIENCE`` on, the first rounds come out of one such MLlib run,
    which bins the rows once for all its trees; it may fit some trees beyond the stop, which are cut. A run that ends before the stop is followed by one
    twice as long from the start, whose first trees are the same; only where ``max_rounds`` leaves few rounds
    (``TREE_ALONE``) do these go on as above.
    The result is one ensemble of the first ``best`` trees."""
    p = {**lrn.params, **over}
    step, most = p.pop("stepSize", 0.1), min(lrn.max_rounds, p.pop("maxIter", lrn.max_rounds))
    every = max(2, min(lrn.patience, 10))
    fit, valid = (rows.select("features", "label") for rows in (fit, valid))
    trees, losses = [], []

    def weights(start: int) -> list:
        return [1.0 if i == 0 else step for i in range(start, len(trees))]

    def stops(rounds: int) -> bool:
        return int(np.argmin(losses[:rounds])) + 1 + lrn.patience <= rounds or rounds >= most

    patient = lrn.patience >= LONG_PATIENCE
    if patient or fit.count() >= LONG_RUN_ROWS:
        rounds = min(most, max(1, (2 * lrn.patience if patient else LONG_RUN_ROUNDS * min(lrn.patience, 2)) // every) * every)
        while True:
            run = GBTRegressor(featuresCol="features", labelCol="label", stepSize=step, seed=seed, maxIter=rounds, **p).fit(fit)
            trees, losses = list(run._java_obj.trees()), run.evaluateEachIteration(valid, "squared")
            seen = [n for n in range(1, len(trees) + 1) if (n % every == 0 or n == most) and stops(n)]
            if seen:
                best = int(np.argmin(losses[:seen[0]])) + 1
                return ensemble(trees[:best], weights(0)[:best]), best
            if TREE_ALONE * (most - rounds) < most:
                break
            rounds = min(most, 2 * rounds)
    fit, valid = (_Residual(rows if trees else rows.persist()) for rows in (fit, valid))
    if trees:
        fit.go_on(trees, weights(0))
        valid.go_on(trees, weights(0))
    while True:
        start = len(trees)
        for _ in range(min(every, most - start)):
            forest = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=1, bootstrap=False,
                                           seed=seed + len(trees), **p)
            if len(trees) > start:
                fit.go_on(trees[-1:], weights(len(trees) - 1))
            rows = fit.rows.withColumn("label", 2 * F.col("label")) if trees else fit.rows
            model = forest.fit(rows)                      # named until its trees are out: its end frees the JVM's object
            trees.append(model._java_obj.trees()[0])
            fit.settle()
        losses += ensemble(trees[start:], weights(start)).evaluateEachIteration(valid.rows, "squared")
        valid.settle()
        if stops(len(trees)):
            break
        fit.go_on(trees[-1:], weights(len(trees) - 1))
        valid.go_on(trees[start:], weights(start))
    best = int(np.argmin(losses)) + 1
    fit.end()
    valid.end()
    return ensemble(trees[:best], weights(0)[:best]), best


class _Residual:
    """Kept rows ``features, label`` whose label goes on to what further trees leave over."""

    def __init__(self, rows: DataFrame):
        self.rows, self.old, self.files, self.rounds = rows, None, None, 0

    def go_on(self, trees: Sequence, weights: Sequence[float]) -> None:
        """Take the trees' predictions off the label. The rows before stay until ``settle``."""
        left = ensemble(trees, weights).transform(self.rows).select(
            "features", (F.col("label") - F.col("prediction")).alias("label"))
        self.rounds += len(trees)
        self.old = self.rows
        if self.rounds >= RESIDUAL_ROUNDS:
            left, before = stored(left, "residuals"), self.files
            if before is not None:
                discard(before)
            self.files, self.rounds = left, 0
        self.rows = left.persist()

    def settle(self) -> None:
        """Let the rows before go, after a pass over all of the new ones has kept these."""
        if self.old is not None:
            self.old.unpersist()
            self.old = None

    def end(self) -> None:
        self.rows.unpersist()
        if self.files is not None:
            discard(self.files)


def ensemble(trees: Sequence, weights: Sequence[float]) -> GBTRegressionModel:
    """The boosted ensemble of fitted trees (MLlib's objects) and their weights."""
    sc = SparkContext._active_spark_context
    gateway = sc._gateway
    ts = gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    ws = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights)):
        ts[i], ws[i] = t, float(w)
    return GBTRegressionModel(sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel("foldspark-boosted", ts, ws))


def _collect(parts: list) -> DataFrame:
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)                      # J6: fold rows written back by id
    return stored(preds, "cv-predictions")


def _fill_expr(c: str, meds, f: int) -> Column:
    key = f"med_{c}_{f}"
    has = key in meds if isinstance(meds, dict) else key in meds.asDict()
    return F.coalesce(F.col(c), _lit(meds[key])).alias(c) if has else F.col(c)


def _filled(x: DataFrame, features: Sequence[str], meds, f: int) -> DataFrame:
    return x.select("id", "__train", "__fold", "label", *[_fill_expr(c, meds, f) for c in features])


def run_cv(df: DataFrame, features: Sequence[str], lrn: Learner, *, target: str = "target",
           k: int = 5, fold_col: str = "fold", train_col: str = "is_train", id_col: str = "id",
           seed: int = 42, experiment: str | None = None, extra_train: DataFrame | None = None,
           label_fn: Callable[[Column], Column] | None = None,
           inverse_fn: Callable[[Column], Column] | None = None,
           parallel: int | None = None, prepared: Prepared | None = None, fold_seed: int | None = None) -> CVResult:
    """M11 (+ M12 with ``extra_train`` rows ``(id, label, model_fold, features...)``,
    M13 with ``label_fn`` / ``inverse_fn``). ``prepared``: a table of ``prepare`` to read instead of making one."""
    ensure_checkpoint_dir(df.sparkSession)
    own = prepared is None
    if own:
        prepared = prepare(df, features, target=target, k=k, fold_col=fold_col, train_col=train_col, id_col=id_col,
                           label_fn=label_fn)
    extra = None
    if extra_train is not None:
        extra = extra_train.select(F.col(id_col).alias("id"), F.col("label").cast("double").alias("label"),
                                   F.col("model_fold").cast("int").alias("model_fold"),
                                   *[F.col(c).cast("double").alias(c) for c in prepared.features])
    res = _cv(prepared, lrn, seed, experiment or lrn.name, range(prepared.k), fold_seed, extra, parallel)
    res.inverse = inverse_fn or (lambda c: c)
    if own:
        prepared.discard()
    return res


def _cv(prepared: Prepared, lrn: Learner, seed: int, experiment: str, which: Sequence[int], fold_seed: int | None = None,
        extra: DataFrame | None = None, parallel: int | None = None) -> CVResult:
    """The fold models ``which`` of one learner, side by side."""
    base, meds = prepared.folded(fold_seed)
    features, k = prepared.features, prepared.k
    importances, best_iters = [], {}
    moments = fold_moments(base, features, meds, k) if lrn.scale and extra is None else None

    def one_fold(f: int) -> DataFrame:
        x = _filled(base, features, meds, f)
        ex = None
        if extra is not None:
            ex = extra.where(F.col("model_fold") == f).select(
                "id", "label", *[_fill_expr(c, meds, f) for c in features])
        return _fit_fold(f, x, features, lrn, seed, experiment, ex, importances, best_iters, moments)

    with ThreadPoolExecutor(max_workers=_folds_abreast(prepared, lrn, parallel or len(which))) as pool:
        parts = list(pool.map(one_fold, which))
    return CVResult(experiment, _collect(parts), importances, best_iters)


def _folds_abreast(prepared: Prepared, lrn: Learner, wanted: int) -> int:
    """Fits side by side on a prepared table; one fold at a time if each has fits of its own for the classes."""
    if lrn.kind == "one_vs_rest_ev":
        return 1
    return abreast(prepared.table.sparkSession, prepared.table.where("__train").count(), len(prepared.features), max(1, wanted))


def run_cv_encoded(df: DataFrame, numeric: Sequence[str], cats: Sequence[str], lrn: Learner, *,
                   target: str = "target", k: int = 5, fold_col: str = "fold", train_col: str = "is_train",
                   id_col: str = "id", seed: int = 42, smoothing: float = 10.0, experiment: str | None = None,
                   parallel: int | None = None) -> CVResult:
    """M3: categories (missing as a level, P5) enter as target statistics computed
    inside each model fold: fold-train rows get out-of-inner-fold encodings, the
    held-out fold and unlabelled rows get the full fold-train encoding (no target
    of a scored row reaches its own features). The encodings of all model folds come out of one
    aggregate (``encode.nested_target_encoding``) and are stored once."""
    from foldspark.operators import clean, encode
    ensure_checkpoint_dir(df.sparkSession)
    experiment = experiment or f"{lrn.name}_category"
    src = folds.hash_folds(clean.missing_as_level(df, list(cats)), k, seed + 1000, id_col, out="__inner")
    encoded = encode.nested_target_encoding(src, list(cats), target, fold_col, "__inner", train_col, k, k, smoothing)
    names = [f"fe_te_{c}" for c in cats]
    own = [f"{n}_{f}" for n in names for f in range(k)]
    flat = encoded.select("*", *[F.get(n, F.lit(f)).alias(f"{n}_{f}") for n in names for f in range(k)])
    prepared = prepare(flat, [*numeric, *own], target=target, k=k, fold_col=fold_col, train_col=train_col, id_col=id_col)
    base, meds = prepared.folded()
    features = [*numeric, *names]
    importances, best_iters = [], {}

    def one_fold(f: int) -> DataFrame:
        x = base.select("id", "__train", "__fold", "label", *[_fill_expr(c, meds, f) for c in numeric],
                        *[F.col(f"{n}_{f}").alias(n) for n in names])
        return _fit_fold(f, x, features, lrn, seed, experiment, None, importances, best_iters)

    with ThreadPoolExecutor(max_workers=_folds_abreast(prepared, lrn, parallel or k)) as ex_:
        parts = list(ex_.map(one_fold, range(k)))
    preds = _collect(parts)
    prepared.discard()
    return CVResult(experiment, preds, importances, best_iters)


def importance_table(spark, res: CVResult) -> DataFrame:
    """Gain-style importances per fold (k x features rows) and their mean."""
    t = spark.createDataFrame(res.importances, "fold int, feature string, importance double")
    return t.groupBy("feature").agg(F.avg("importance").alias("mean_importance"),
                                    F.stddev_pop("importance").alias("std_importance"),
                                    F.count(F.lit(1)).alias("n_folds"))


# ---- M14 chained-equation imputation --------------------------------------------------

def impute_chained(df: DataFrame, cols: Sequence[str], rounds: int = 5, id_col: str = "id",
                   make_estimator: Callable[[], object] | None = None) -> DataFrame:
    """Start from column means; each round, for every column that had nulls (fewest nulls first), fit
    a regressor on rows where it was observed (other columns at their current values)
    and replace the originally-missing values by its predictions.

    The rows are stored once with their gaps. What a gap holds follows from the models so far, which a pass over the rows
    applies one after the other where a value is missing (``_imputed``); no join, no table of cells. Between two models the
    rows stay in memory (or on the executors' disks), so a fit applies the newest model only (not where ids repeat: kept rows
    behind a shuffle name its plan twice, so the text of a chain of them doubles with every model). Rows of one id,
    should ids repeat, share the largest of their predictions. After ``CHAIN``
    models the rows are stored anew. ``make_estimator`` gives any MLlib regressor (features ``features``, label ``__label``, prediction ``__p``); linear least squares by
    default. A column without any value stays null and is no feature of the others."""
    from pyspark.ml.regression import LinearRegression
    ensure_checkpoint_dir(df.sparkSession)
    make = make_estimator or (lambda: LinearRegression(featuresCol="features", labelCol="__label",
                                                       predictionCol="__p", solver="normal"))
    # not dealt anew: near-singular least squares follow the order of the sums
    base = stored(df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in cols]), "imputed-rows")
    stats = base.agg(F.count("*").alias("__n"), *[F.count(c).alias(f"n_{c}") for c in cols],
                     *[F.avg(c).alias(f"m_{c}") for c in cols]).first()
    cols = [c for c in cols if stats[f"n_{c}"]] if stats["__n"] else list(cols)
    todo = sorted((c for c in cols if stats[f"n_{c}"] < stats["__n"]), key=lambda c: (-stats[f"n_{c}"], cols.index(c)))
    if not todo:
        return base.select(F.col("__id").alias(id_col), *cols)
    rows = base.select("__id", *[F.col(c).isNull().alias(f"__miss_{c}") for c in todo],
                       *[(F.coalesce(c, F.lit(float(stats[f"m_{c}"]))).alias(c) if c in todo else F.col(c)) for c in cols])
    repeated = not base.groupBy("__id").count().where("count > 1").isEmpty()
    kept, chained = None, 0
    for step in range(rounds * len(todo)):
        c = todo[step % len(todo)]
        others = [o for o in cols if o != c]
        fit = rows.where(~F.col(f"__miss_{c}")).select(F.col(c).alias("__label"), *others)
        model = make().fit(VectorAssembler(inputCols=others, outputCol="features").transform(fit))
        if kept is not None:                              # the fit has read, and so kept, all of the rows after it
            kept.unpersist()
        kept, chained = (rows if chained and not repeated else None), chained + 1
        rows = _imputed(rows, model, c, others, repeated)
        if chained >= CHAIN and step + 1 < rounds * len(todo):
            after = stored(rows, "imputed-rows")
            discard(base)
            if kept is not None:
                kept.unpersist()
            rows, base, kept, chained = after, after, None, 0
        elif not repeated and step + 1 < rounds * len(todo):
            rows = rows.persist()
    out = stored(rows.select(F.col("__id").alias(id_col), *cols), "imputed")
    if kept is not None:
        kept.unpersist()
    discard(base)
    return out


#: Models that one plan of an imputation applies at most.
CHAIN = 24


def _imputed(rows: DataFrame, model, c: str, others: Sequence[str], repeated: bool) -> DataFrame:
    """``rows`` with the model's predictions where ``c`` was missing. A linear model is a column expression, evaluated in
    the rows with the gap only. ``repeated``: rows of one id share the largest of their predictions."""
    gap = F.col(f"__miss_{c}")
    if isinstance(model, LinearRegressionModel):
        value = F.lit(float(model.intercept))
        for o, w in zip(others, model.coefficients.toArray()):
            value = value + F.lit(float(w)) * F.col(o)
        scored = rows.withColumn("__p", F.when(gap, value))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(others), outputCol="features").transform(rows))
    pred = F.max(F.when(gap, F.col("__p"))).over(Window.partitionBy("__id")) if repeated else F.col("__p")
    return scored.withColumn(c, F.when(gap, pred).otherwise(F.col(c))).select(*rows.columns)


# ---- M15 run matrix ----------------------------------------------------------------------

#: Fixed values of the source's multi-seed runs.
SEEDS = (42, 123, 456, 789, 2024)


@dataclass
class MatrixResult:
    """The store of a run matrix and the jobs that this call has fitted."""
    spark: SparkSession
    path: str
    models: list
    fitted: list

    def predictions(self) -> DataFrame:
        """``seed, model, fold, id, split, pred``."""
        return self.spark.read.schema("id bigint, split string, pred double, seed int, model string, fold int").parquet(
            f"{self.path}/predictions")

    def averaged(self) -> DataFrame:
        """G18 (and G19): ``id, split, model, pred, n_avg``, the mean over the seeds (and, for test rows, their fold models).

        Rows are dealt by key before they are averaged: the files of a fit name an id once, so sums taken before the
        shuffle would save nothing and hold a row of memory for every row read."""
        keys = ["id", "split", "model"]
        return blend.average_over(self.predictions().repartition(*keys), keys)

    def stacked(self, labels: DataFrame, target: str = "target", alpha: float = 1.0,
                clip: tuple[float, float] = (0.0, 10.0)) -> tuple[DataFrame, np.ndarray, float]:
        """J5 + B3: ``id, split, <model>..., pred``, one column a model and their ridge stack, with its weights and intercept."""
        wide = blend.wide(self.averaged(), self.models, ["id", "split"])
        fit = wide.where("split = 'oof'").join(labels.select("id", F.col(target).alias("__y")), "id")
        coef, icpt = blend.ridge_stack(fit, self.models, "__y", alpha)
        return wide.withColumn("pred", X.clip(blend.linear_score(self.models, coef, icpt), *clip)), coef, icpt


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_matrix(df: DataFrame, features: Sequence[str], learners: Mapping[str, Learner], path: str, *,
               seeds: Sequence[int] = SEEDS, k: int = 5, target: str = "target", train_col: str = "is_train",
               id_col: str = "id", extra_train: DataFrame | None = None, parallel: int = 8) -> MatrixResult:
    """M15 + K3: every learner under every seed (its folds and its model seed), ``seeds x learners x k`` fits.

    Each fit is a job of its own in the FAIR pool of its learner and ends with its predictions below
    ``path`` (``predictions/seed=/model=/fold=``, written whole or not at all). A call on a path with
    finished jobs fits the others only. When all are there, each (learner, seed) that this call has touched gets a
    record in the log ``path``/log (S12). ``extra_train``: rows ``(id, label, features...)`` that every fold model
    trains on besides (M12)."""
    spark = df.sparkSession
    jobs = [(s, m, f) for s in seeds for m in learners for f in range(k)]
    place = {j: f"{path}/predictions/seed={j[0]}/model={j[1]}/fold={j[2]}" for j in jobs}
    todo = [j for j in jobs if not _exists(spark, f"{place[j]}/_SUCCESS")]
    if todo:
        prepared = prepare(df, features, target=target, k=k, fold_col=None, train_col=train_col, id_col=id_col,
                           seeds=sorted({s for s, _, _ in todo}))
        extra = None if extra_train is None else extra_train.select(
            F.col(id_col).alias("id"), F.col("label").cast("double").alias("label"),
            *[F.col(c).cast("double").alias(c) for c in features])
        began = time.time()

        def one(job: tuple) -> None:
            s, m, f = job
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", m)
            base, meds = prepared.folded(s)
            ex = None if extra is None else extra.select("id", "label", *[_fill_expr(c, meds, f) for c in prepared.features])
            out = _fit_fold(f, _filled(base, prepared.features, meds, f), prepared.features, learners[m], s, m, ex, [], {})
            out.select("id", "split", "pred").write.mode("overwrite").parquet(place[job])

        with ThreadPoolExecutor(max_workers=min(_folds_abreast(prepared, m, parallel) for m in learners.values())) as pool:
            list(pool.map(one, todo))
        took = time.time() - began
        prepared.discard()
    res = MatrixResult(spark, path, list(learners), todo)
    touched = sorted({(m, s) for s, m, _ in todo})
    if touched:
        y = df.select(F.col(id_col).alias("id"), F.col(target).alias("target"))
        scored = res.predictions().where("split = 'oof'").join(y, "id")
        rows = M.rmse(scored, by=["model", "seed", "fold"]).collect()      # one row a job
        for m, s in touched:
            scores = [r["rmse"] for r in sorted(rows, key=lambda r: r["fold"]) if (r["model"], r["seed"]) == (m, s)]
            store.log_experiment(spark, f"{path}/log", f"{m}_seed{s}", float(np.mean(scores)), float(np.std(scores)), scores,
                                 took, {"model": m, "seed": s})
    return res


# ---- M16 random search -----------------------------------------------------------------

@dataclass
class Space:
    """Bounded search space: name -> (kind, lo, hi); kind in float / logfloat / int / logint, or fraction (a share
    written as text, as ``featureSubsetStrategy`` takes it)."""
    dims: dict

    def sample(self, rng: random.Random) -> dict:
        out = {}
        for name, (kind, lo, hi) in self.dims.items():
            if kind == "int":
                out[name] = rng.randint(int(lo), int(hi))
            elif kind in ("logfloat", "logint"):
                v = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
                out[name] = v if kind == "logfloat" else round(v)
            else:
                v = float(rng.uniform(lo, hi))
                out[name] = repr(round(v, 4)) if kind == "fraction" else v
        return out


# The source's ranges, on the parameters that MLlib has of them (it has no leaf
# penalties, column shares by level or bagging temperature).
SPACES: dict[str, Space] = {
    "gbt_leafwise": Space({"stepSize": ("logfloat", 0.01, 0.1), "maxDepth": ("int", 4, 12),
                           "minInstancesPerNode": ("int", 5, 100), "featureSubsetStrategy": ("fraction", 0.5, 1.0),
                           "subsamplingRate": ("float", 0.5, 1.0), "minInfoGain": ("float", 0.0, 1.0)}),
    "gbt_depthwise": Space({"stepSize": ("logfloat", 0.01, 0.1), "maxDepth": ("int", 4, 12),
                            "minInstancesPerNode": ("logint", 1, 20), "featureSubsetStrategy": ("fraction", 0.5, 1.0),
                            "subsamplingRate": ("float", 0.5, 1.0), "minInfoGain": ("float", 0.0, 5.0)}),
    "gbt_category": Space({"stepSize": ("logfloat", 0.01, 0.1), "maxDepth": ("int", 4, 10),
                           "minInstancesPerNode": ("int", 1, 100), "maxBins": ("int", 32, 255)}),
}


def random_search(df: DataFrame, features: Sequence[str], base: Learner, space: Space, n_trials: int = 40,
                  seed: int = 42, refit: Learner | None = None, first_folds: int | None = None, keep: float = 0.5,
                  parallel: int = 8, path: str | None = None, **cv_kw):
    """Seeded random trials, each scored over the folds (objective = pooled OOF RMSE).

    All trials read one prepared table and run side by side; a trial leaves two numbers a fold, no table.
    With ``first_folds`` set, every trial runs that many folds first and only the best ``keep`` of the trials
    (one at least) run the rest; the others keep the score of their first folds and ``complete = false``.
    ``refit``: a learner with a longer budget, run once with the best complete trial's parameters. With
    ``path``, these parameters are saved (S14) and the refit, or else the best trial, is logged (S12).

    Returns ``(trials DataFrame, best params, refit result or None)``; the trial table stores params as a map."""
    spark, rng, began = df.sparkSession, random.Random(seed), time.time()
    params = [space.sample(rng) for _ in range(n_trials)]
    prepared = prepare(df, features, **cv_kw)
    table, meds = prepared.folded()
    found: dict[int, dict[int, tuple]] = {t: {} for t in range(n_trials)}

    def one(job: tuple) -> None:
        t, f = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{t}")
        lrn = replace(base, params={**base.params, **params[t]})
        out = _fit_fold(f, _filled(table, prepared.features, meds, f), prepared.features, lrn, seed, base.name, None, [], {},
                        labels=True)
        r = out.where("split = 'oof'").agg(F.sum((F.col("label") - F.col("pred")) ** 2).alias("sse"), F.count("*").alias("n")).first()
        found[t][f] = (r["sse"] or 0.0, r["n"])

    def score(t: int) -> float:
        return math.sqrt(sum(e for e, _ in found[t].values()) / max(1, sum(n for _, n in found[t].values())))

    k, first = prepared.k, min(first_folds or prepared.k, prepared.k)
    with ThreadPoolExecutor(max_workers=_folds_abreast(prepared, base, parallel)) as pool:
        list(pool.map(one, [(t, f) for t in range(n_trials) for f in range(first)]))
        on = sorted(range(n_trials), key=lambda t: (score(t), t))[:max(1, math.ceil(keep * n_trials)) if first < k else n_trials]
        list(pool.map(one, [(t, f) for t in sorted(on) for f in range(first, k)]))
    rows = []
    for t in range(n_trials):
        each = [math.sqrt(e / n) for e, n in found[t].values() if n]
        rows.append((t, {p: float(v) for p, v in params[t].items()}, score(t), float(np.std(each)) if each else None,
                     len(found[t]), len(found[t]) == k))
    trials = spark.createDataFrame(rows, "trial int, params map<string,double>, cv_rmse double, cv_std double, n_folds int, "
                                         "complete boolean")
    winner = min(on, key=lambda t: (score(t), t))
    final = None
    if refit is not None:
        final = run_cv(df, features, replace(refit, params={**refit.params, **params[winner]}),
                       experiment=f"{base.name}_tuned", seed=seed, prepared=prepared)
    if path is not None:
        store.save_params(spark, f"{path}/params", base.name, params[winner])
        scores = [math.sqrt(e / n) for _, (e, n) in sorted(found[winner].items()) if n]
        if final is not None:
            y = table.where("__train").select("id", F.col("label").alias("target"))
            scores = [r["rmse"] for r in M.rmse(final.oof().join(y, "id"), by=["fold"]).orderBy("fold").collect()]
        store.log_experiment(spark, f"{path}/log", f"{base.name}_tuned", float(np.mean(scores)), float(np.std(scores)), scores,
                             time.time() - began, {"trials": n_trials, "trial": winner})
    prepared.discard()
    return trials, params[winner], final


# ---- M6 by sufficient statistics -------------------------------------------------------

def ridge_cv(df: DataFrame, features: Sequence[str], *, alpha: float = 1.0, target: str = "target",
             k: int = 5, fold_col: str = "fold", train_col: str = "is_train", id_col: str = "id",
             experiment: str = "ridge") -> CVResult:
    """M6 + M11 by sufficient statistics: ridge (with intercept) on columns filled with
    fold-train medians and standardised with fold-train mean / population std,
    one model per fold, exactly as a per-fold fit would compute it.

    Passes over the data: null check + means, fold medians (columns with nulls),
    one moment pass (numpy per partition: ``U'U`` and ``U'y`` for each fold, where
    ``u`` = shifted values with nulls as 0 plus null flags; summed per fold by a
    ``groupBy`` of ``k x P`` numbers), then scoring as a linear column expression.
    The driver only solves ``k`` systems of size ``features x features``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    features = list(features)
    p = len(features)
    # stored once: every pass below, scoring included, reads a plain table
    base = stored(_prepare(df, features, target, fold_col, train_col, id_col, None), "cv-table")
    tr = base.where(F.col("__train"))
    stats = tr.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in features],
                   *[F.avg(c).alias(f"a_{c}") for c in features]).first()
    need = [c for c in features if stats[f"z_{c}"] > 0]
    q_idx = [features.index(c) for c in need]
    shift = np.array([stats[f"a_{c}"] or 0.0 for c in features])
    meds = foldstats.fold_medians(base, need, k, "__fold", "__train").first().asDict() \
        if need else {}
    width = 1 + (p + len(need)) + 2 + (p + len(need)) ** 2 + (p + len(need))
    def moment_sums(pdf_iter):
        """Per partition and fold: n, sum u, sum y, sum y^2, U'U, U'y with
        u = [x - shift (nulls as 0), null flags]. Defined here so it is shipped
        by value (numpy / pandas only), not imported on the executors."""
        import numpy as _np
        import pandas as _pd
        acc: dict = {}
        for pdf in pdf_iter:
            if pdf.empty:
                continue
            X = pdf[features].to_numpy(dtype=float)          # Arrow turns nulls into NaN
            y = pdf["label"].to_numpy(dtype=float)
            M = _np.isnan(X[:, q_idx]).astype(float) if q_idx else _np.zeros((len(X), 0))
            U = _np.hstack([_np.where(_np.isnan(X), 0.0, X - shift), M])
            folds_ = pdf["__fold"].to_numpy()
            for f in _np.unique(folds_):
                sel = folds_ == f
                Uf, yf = U[sel], y[sel]
                v = _np.concatenate([[sel.sum()], Uf.sum(0), [yf.sum(), (yf * yf).sum()],
                                     (Uf.T @ Uf).ravel(), Uf.T @ yf])
                acc[int(f)] = acc.get(int(f), 0.0) + v
        if acc:
            yield _pd.DataFrame({"fold": list(acc), "v": [v.tolist() for v in acc.values()]})

    parts = tr.select("__fold", *features, "label").mapInPandas(moment_sums, "fold int, v array<double>")
    sums = (parts.select("fold", F.posexplode("v").alias("i", "x")).groupBy("fold", "i").agg(F.sum("x").alias("x"))
                 .collect())
    per = {}
    for r in sums:
        per.setdefault(r["fold"], np.zeros(width))[r["i"]] = r["x"]
    total = sum(per.values())
    d = p + len(need)
    coefs = {}
    for f in range(k):
        s = total - per.get(f, 0.0)
        n = s[0]
        su = s[1:1 + d]
        sy, syy = s[1 + d], s[2 + d]
        UU = s[3 + d:3 + d + d * d].reshape(d, d)
        Uy = s[3 + d + d * d:3 + d + d * d + d]
        T = np.zeros((p, d))                    # x_filled - shift = T u
        T[:, :p] = np.eye(p)
        for j, c in enumerate(need):
            T[features.index(c), p + j] = (meds.get(f"med_{c}_{f}") or 0.0) - shift[features.index(c)]
        sx, xx, xy = T @ su, T @ UU @ T.T, T @ Uy
        mu = sx / n
        gc = xx - n * np.outer(mu, mu)
        sd = np.sqrt(np.clip(np.diag(gc) / n, 0, None))
        sd[sd == 0] = 1.0
        ybar = sy / n
        gz = gc / np.outer(sd, sd)
        bz = (xy - n * mu * ybar) / sd
        wz = np.linalg.solve(gz + alpha * np.eye(p), bz)
        w = wz / sd                            # on the (x - shift) scale
        coefs[f] = (float(ybar - mu @ w), w)
    # scoring: labelled rows with their fold's model; others with the mean of the k models
    mf = F.col("__fold")

    def per_fold(vals):
        return F.element_at(F.array(*[F.lit(float(v)) for v in vals]), mf + 1)

    valid = per_fold([coefs[f][0] for f in range(k)])
    test = F.lit(float(np.mean([coefs[f][0] for f in range(k)])))
    for j, c in enumerate(features):
        xs = F.col(c) - F.lit(float(shift[j]))
        ws = [coefs[f][1][j] for f in range(k)]
        if c in need:
            medv = [(meds.get(f"med_{c}_{f}") or 0.0) - shift[j] for f in range(k)]
            valid = valid + per_fold(ws) * F.coalesce(xs, per_fold(medv))
            test = test + F.when(F.col(c).isNull(), F.lit(float(np.mean([ws[f] * medv[f] for f in range(k)])))) \
                .otherwise(F.lit(float(np.mean(ws))) * xs)
        else:
            valid = valid + per_fold(ws) * xs
            test = test + F.lit(float(np.mean(ws))) * xs
    pred = F.when(F.col("__train"), valid).otherwise(test)
    preds = base.select(F.lit(experiment).alias("experiment"), "id",
                        F.when(F.col("__train"), F.col("__fold")).alias("fold"),
                        F.when(F.col("__train"), F.lit("oof")).otherwise(F.lit("test")).alias("split"),
                        pred.cast("double").alias("pred"))
    return CVResult(experiment, preds, [], {})
