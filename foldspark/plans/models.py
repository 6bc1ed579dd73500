"""Learners on Spark MLlib.

A learner is a factory of MLlib estimators plus the column preparation it
needs. Boosting libraries are not used: gradient-boosted trees, random forests,
linear regression and isotonic regression come from ``pyspark.ml``. Differences
from the source's boosters are listed per learner.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor


@dataclass
class Learner:
    name: str
    make: Callable[..., object]          # (seed, **params) -> MLlib estimator
    params: dict = field(default_factory=dict)
    scale: bool = False                  # P11 standardisation before fitting
    ridge_alpha: float | None = None     # M6: regParam derived from the fold data
    patience: int | None = None          # M10: boost until the validation loss has not improved for so many rounds
    max_rounds: int = 5000               # M10: upper limit of boosting rounds
    validation: str = "fold"             # loss on the valid fold, or on a hash-chosen tenth of the fit rows ("inner")
    kind: str = "regressor"              # or "classifier_ev", "one_vs_rest_ev" (M7: expected class value)
    classes: int = 11                    # M7: the labels are 0 ... classes - 1

    def estimator(self, seed: int, **over):
        return self.make(seed, **{**self.params, **over})


def _gbt(seed, **p):
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", seed=seed, **p)


def _forest(seed, **p):
    return RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="prediction",
                                 seed=seed, **p)


def _linear(seed, **p):
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="prediction",
                            solver="normal", elasticNetParam=0.0, standardization=False, **p)


def _forest_classifier(seed, **p):
    return RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="prediction",
                                  probabilityCol="probability", seed=seed, **p)


def _boosted_classifier(seed, **p):
    return GBTClassifier(featuresCol="features", labelCol="label", predictionCol="prediction", seed=seed, **p)


# Rounds, patience, trees and depths default to the source workload's values. MLlib boosting is
# sequential in rounds, so catalogue queries pass smaller values explicitly (see QUICK).
LEARNERS: dict[str, Learner] = {
    # M1: leaf-wise booster in the source; MLlib grows depth-wise with no L1/L2 terms
    "gbt_leafwise": Learner("gbt_leafwise", _gbt, dict(stepSize=0.05, maxDepth=5, minInstancesPerNode=30,
                                                       subsamplingRate=0.85, featureSubsetStrategy="0.85"),
                            patience=200),
    # M2: depth-wise booster
    "gbt_depthwise": Learner("gbt_depthwise", _gbt, dict(stepSize=0.05, maxDepth=6, minInstancesPerNode=5,
                                                         subsamplingRate=0.85, featureSubsetStrategy="0.85"),
                             patience=200),
    # M4: histogram booster with a 10 % internal validation part
    "gbt_hist": Learner("gbt_hist", _gbt, dict(stepSize=0.05, maxDepth=5, maxBins=255, minInstancesPerNode=30),
                        patience=50, max_rounds=1000, validation="inner"),
    # M5: randomised forest without bootstrap; MLlib searches the best split (no random thresholds)
    "forest": Learner("forest", _forest, dict(numTrees=500, maxDepth=20, minInstancesPerNode=5,
                                              featureSubsetStrategy="0.7", bootstrap=False)),
    # M6: ridge on standardised columns; regParam = alpha / n * sd(y)
    "ridge": Learner("ridge", _linear, dict(maxIter=100), scale=True, ridge_alpha=1.0),
    # M7: boosted 11-class model -> expected value. MLlib's boosted classifier is binary, so one model a class
    # against the rest, probabilities divided by their sum
    "class_boost": Learner("class_boost", _boosted_classifier, dict(maxIter=300, stepSize=0.05, maxDepth=5, minInstancesPerNode=30),
                           kind="one_vs_rest_ev"),
    # M7, second form: a forest of all classes at once
    "class_ev": Learner("class_ev", _forest_classifier, dict(numTrees=500, maxDepth=10, minInstancesPerNode=5),
                        kind="classifier_ev"),
    # M9: shallow, strongly regularised booster as meta-learner
    "meta_gbt": Learner("meta_gbt", _gbt, dict(stepSize=0.02, maxDepth=3, minInstancesPerNode=200),
                        patience=100, max_rounds=2000),
}

#: Explicit smaller settings of the catalogue queries and the bench: a larger step, a short patience, few trees.
QUICK: dict[str, dict] = {
    "gbt_leafwise": dict(stepSize=0.3, patience=3), "gbt_depthwise": dict(stepSize=0.3, patience=3),
    "gbt_hist": dict(stepSize=0.3, patience=3), "meta_gbt": dict(stepSize=0.3, patience=3),
    "forest": dict(numTrees=20, maxDepth=8), "class_ev": dict(numTrees=20, maxDepth=8), "ridge": {},
    "class_boost": dict(maxIter=4, stepSize=0.3, maxDepth=3),
}


def learner(name: str, patience: int | None = None, max_rounds: int | None = None, **over) -> Learner:
    """A named learner; ``over`` replaces estimator parameters, ``patience`` and ``max_rounds`` the stopping rule."""
    base = LEARNERS[name]
    return replace(base, params={**base.params, **over}, patience=base.patience if patience is None else patience,
                   max_rounds=base.max_rounds if max_rounds is None else max_rounds)


def quick(name: str, **over) -> Learner:
    """The learner with its ``QUICK`` settings."""
    return learner(name, **{**QUICK[name], **over})
