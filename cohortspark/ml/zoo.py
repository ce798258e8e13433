"""Registry of classifiers and their parameter grids.

A factory gets the size of the training set, because the inverse penalty C of a summed loss is the
penalty 1 / (C n) of a mean loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)

from cohortspark.ml.classifiers import AdaBoost, ExtraTrees, KNNClassifier, PerClass, Perceptron, RBFClassifier
from cohortspark.ml.together import Neighbours, Smooth, Trees

# Deepest tree Spark grows; stands for "no limit".
NO_LIMIT = 30


@dataclass
class Setting:
    """What a factory needs to know about the training table."""

    n_rows: int
    n_features: int
    n_classes: int = 2
    seed: int = 42
    id_col: str = "sample_id"


@dataclass
class Entry:
    make: Callable[[Setting, dict], Estimator]
    weighted: bool = False
    grid: dict[str, list] = field(default_factory=dict)
    # How a search fits a parameter point in passes it shares with all others; without it points are fitted one by one.
    together: Callable[[dict], Trees | Smooth | Neighbours] | None = None
    only_in_tasks: bool = False  # a fold that does not fit a task is fitted by itself

    def points(self, select: list | None = None) -> list[dict]:
        """All parameter combinations, crossed with the feature counts when selection is searched."""
        if not self.grid:
            return []
        axes = dict(self.grid)
        if select:
            axes["k"] = select
        return [dict(zip(axes, values)) for values in product(*axes.values())]


# Feature counts searched next to the model parameters.
SELECT_GRID = [6, 8, 10, "all"]


def _logistic(s: Setting, p: dict) -> Estimator:
    return LogisticRegression(
        regParam=1.0 / (p.get("C", 1.0) * s.n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=p.get("max_iter", 2000),
        family="multinomial" if s.n_classes > 2 else "binomial",
    )


def _knn(s: Setting, p: dict) -> Estimator:
    return KNNClassifier(k=p.get("neighbours", 5), numClasses=s.n_classes, idCol=s.id_col)


def _bayes(s: Setting, p: dict) -> Estimator:
    return NaiveBayes(modelType="gaussian")


def _tree(depth: int, leaf: int):
    def make(s: Setting, p: dict) -> Estimator:
        return DecisionTreeClassifier(
            maxDepth=p.get("depth", depth), minInstancesPerNode=p.get("leaf", leaf), seed=s.seed
        )

    return make


def _forest(depth: int, leaf: int):
    def make(s: Setting, p: dict) -> Estimator:
        return RandomForestClassifier(
            numTrees=p.get("trees", 300),
            maxDepth=p.get("depth", depth) or NO_LIMIT,
            minInstancesPerNode=p.get("leaf", leaf),
            featureSubsetStrategy="sqrt",
            bootstrap=True,
            seed=s.seed,
        )

    return make


def _extra(depth: int, leaf: int):
    def make(s: Setting, p: dict) -> Estimator:
        return ExtraTrees(
            trees=p.get("trees", 300),
            depth=p.get("depth", depth) or NO_LIMIT,
            leaf=p.get("leaf", leaf),
            numClasses=s.n_classes,
            idCol=s.id_col,
            seed=s.seed,
        )

    return make


def _boosted(leaf: int, subsample: float):
    def make(s: Setting, p: dict) -> Estimator:
        gbt = GBTClassifier(
            maxIter=p.get("rounds", 100),
            maxDepth=p.get("depth", 3),
            stepSize=p.get("rate", 0.1),
            minInstancesPerNode=p.get("leaf", leaf),
            subsamplingRate=p.get("subsample", subsample),
            seed=s.seed,
        )
        return PerClass(gbt, numClasses=s.n_classes) if s.n_classes > 2 else gbt

    return make


def _adaboost(rounds: int, rate: float):
    def make(s: Setting, p: dict) -> Estimator:
        return AdaBoost(
            rounds=p.get("rounds", rounds), rate=p.get("rate", rate), numClasses=s.n_classes, seed=s.seed
        )

    return make


def _rbf(s: Setting, p: dict) -> Estimator:
    gamma = p.get("gamma", "scale")
    one = RBFClassifier(
        c=float(p.get("C", 1.0)),
        gamma=0.0 if gamma == "scale" else float(gamma),
        size=p.get("size", 256),
        seed=s.seed,
    )
    return PerClass(one, numClasses=s.n_classes) if s.n_classes > 2 else one


def _perceptron(hidden: list[int]):
    def make(s: Setting, p: dict) -> Estimator:
        return Perceptron(
            hidden=p.get("hidden", hidden),
            penalty=p.get("alpha", ALPHA),
            maxIter=p.get("max_iter", NET_STEPS),
            numClasses=s.n_classes,
            seed=s.seed,
        )

    return make


def _xgboost():
    """The optional gradient-boosting library, left out of the registry when it is not installed."""
    try:
        from xgboost.spark import SparkXGBClassifier
    except ImportError:
        return None

    def make(s: Setting, p: dict) -> Estimator:
        return SparkXGBClassifier(
            n_estimators=p.get("rounds", 200),
            max_depth=p.get("depth", 3),
            learning_rate=p.get("rate", 0.05),
            subsample=0.8,
            colsample_bytree=0.8,
            min_child_weight=3,
            reg_lambda=1.0,
            random_state=s.seed,
        )

    return make


# The same models for searches; a forest without a limit of depth has that of Spark's trees.
def _tree_point(depth: int, leaf: int):
    return lambda p: Trees("forest", 1, p.get("depth", depth), p.get("leaf", leaf), weighted=True)


def _forest_point(kind: str, depth: int, leaf: int):
    return lambda p: Trees(
        kind,
        p.get("trees", 300),
        p.get("depth", depth) or NO_LIMIT,
        p.get("leaf", leaf),
        sqrt=True,
        bootstrap=kind == "forest",
        weighted=True,
    )


def _boosted_point(leaf: int, subsample: float):
    return lambda p: Trees(
        "boost",
        p.get("rounds", 100),
        p.get("depth", 3),
        p.get("leaf", leaf),
        rate=p.get("rate", 0.1),
        subsample=p.get("subsample", subsample),
    )


def _ada_point(rounds: int, rate: float):
    return lambda p: Trees("ada", p.get("rounds", rounds), 1, 1, rate=p.get("rate", rate))


def _knn_point(p: dict) -> Neighbours:
    return Neighbours(p.get("neighbours", 5))


def _logistic_point(p: dict) -> Smooth:
    return Smooth(penalty=1.0 / p.get("C", 1.0), weighted=True, max_iter=p.get("max_iter", 2000))


def _rbf_point(p: dict) -> Smooth:
    gamma = p.get("gamma", "scale")
    return Smooth(
        penalty=1.0 / p.get("C", 1.0),
        weighted=True,
        kernel=True,
        gamma=0.0 if gamma == "scale" else float(gamma),
        size=p.get("size", 256),
    )


def _perceptron_point(hidden: tuple[int, ...]):
    return lambda p: Smooth(tuple(p.get("hidden", hidden)), p.get("alpha", ALPHA), max_iter=p.get("max_iter", NET_STEPS))


# Fixed value: the published weight penalty of the network. Steps are those of L-BFGS, each over all rows.
ALPHA, NET_STEPS = 1.0, 200


# Model names, settings and grids of the published runs.
def binary_models() -> dict[str, Entry]:
    models = {
        "LogisticRegression": Entry(_logistic, True, {"C": [0.1, 1.0, 10.0]}, _logistic_point),
        "KNN": Entry(_knn, together=_knn_point, only_in_tasks=True),
        "GaussianNB": Entry(_bayes),
        "DecisionTree": Entry(_tree(4, 3), True, together=_tree_point(4, 3)),
        "RandomForest": Entry(
            _forest(8, 3), True, {"trees": [200, 400], "depth": [None, 8, 12]}, _forest_point("forest", 8, 3)
        ),
        "ExtraTrees": Entry(
            _extra(8, 3), True, {"trees": [200, 400], "depth": [None, 8, 12]}, _forest_point("extra", 8, 3)
        ),
        "GradientBoosting": Entry(
            _boosted(3, 0.8),
            False,
            {"rounds": [100, 200], "depth": [2, 3], "rate": [0.05, 0.1]},
            _boosted_point(3, 0.8),
        ),
        "AdaBoost": Entry(_adaboost(100, 0.5), together=_ada_point(100, 0.5)),
        "SVC_RBF": Entry(_rbf, True, {"C": [1, 10], "gamma": ["scale", 0.1]}, _rbf_point),
        "MLP": Entry(_perceptron([8]), together=_perceptron_point((8,))),
    }
    xgb = _xgboost()
    if xgb is not None:
        models["XGBoost"] = Entry(
            xgb, False, {"rounds": [100, 200], "depth": [2, 3], "rate": [0.03, 0.05, 0.1]}
        )
    return models


def multiclass_models() -> dict[str, Entry]:
    return {
        "LogisticRegression": Entry(_logistic, True, {"C": [0.1, 1.0, 10.0]}, _logistic_point),
        "KNN": Entry(_knn, together=_knn_point, only_in_tasks=True),
        "GaussianNB": Entry(_bayes),
        "DecisionTree": Entry(_tree(6, 1), True, together=_tree_point(6, 1)),
        "RandomForest": Entry(
            _forest(0, 1), True, {"trees": [200, 400], "depth": [None, 10, 16]}, _forest_point("forest", 0, 1)
        ),
        "ExtraTrees": Entry(
            _extra(0, 1), True, {"trees": [200, 400], "depth": [None, 12, 18]}, _forest_point("extra", 0, 1)
        ),
        "GradientBoosting": Entry(
            _boosted(1, 1.0),
            False,
            {"rounds": [150, 300], "depth": [2, 3], "rate": [0.05, 0.1]},
            _boosted_point(1, 1.0),
        ),
        "AdaBoost": Entry(_adaboost(50, 1.0), together=_ada_point(50, 1.0)),
        "SVC_RBF": Entry(_rbf, True, {"C": [1, 10], "gamma": ["scale", 0.1]}, _rbf_point),
        "MLP": Entry(_perceptron([32, 16]), together=_perceptron_point((32, 16))),
    }
