"""Classifiers that ``pyspark.ml`` does not have, as estimators built from its parts."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.ml import descent, gang
from cohortspark.ml.saving import CompositeModel
from cohortspark.ml.together import Smooth, Trees, pass_rows
from cohortspark.operators.neighbours import NeighbourIndex, knn_vote, limit_copies, vector_key
from cohortspark.session import fresh_path


class _Shared(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class number", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight, empty for none", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row key", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            featuresCol="features", labelCol="label", weightCol="", idCol="sample_id", numClasses=2, seed=42
        )

    def _copy_shared(self, other: "_Shared") -> None:
        for name in ("featuresCol", "labelCol", "weightCol", "idCol", "numClasses", "seed"):
            other._set(**{name: self.getOrDefault(name)})


class _Base(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)


class _Fitted(CompositeModel, _Shared):
    def __init__(self):
        super().__init__()
        self._defaults()


class _Packed(_Fitted):
    """Model whose state is text; ``chances`` makes of it a function from a matrix to class probabilities."""

    packed = Param(Params._dummy(), "packed", "state as JSON", TypeConverters.toString)

    def chances(self):
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = self.chances()

        @F.pandas_udf("array<double>")
        def chance(rows: pd.Series) -> pd.Series:
            return pd.Series(list(of(np.vstack(rows.to_list())))) if len(rows) else pd.Series([], dtype=object)

        return _finish(dataset.withColumn("_p", chance(vector_to_array(self.getOrDefault("featuresCol")))))


def _rows(estimator: _Base, dataset: DataFrame) -> DataFrame:
    """The training rows as the shared passes read them."""
    name, key = estimator.getOrDefault("weightCol"), estimator.getOrDefault("idCol")
    x = vector_to_array(estimator.getOrDefault("featuresCol"))
    row_key = F.col(key) if key in dataset.columns else x
    return pass_rows(dataset, x, estimator.getOrDefault("labelCol"), row_key, F.col(name) if name else None)


def _width(rows: DataFrame) -> int:
    return len(rows.select("x").first()["x"])


def _grow(estimator: _Base, dataset: DataFrame, kind: str, own: dict) -> gang.Gang:
    rows = _rows(estimator, dataset).persist()
    member = Trees(kind, **own).member(0, range(_width(rows)), estimator.getOrDefault("seed"))
    grown = gang.grow(rows, [member], estimator.getOrDefault("numClasses"))
    rows.unpersist()
    return grown


# --- k nearest neighbours ---------------------------------------------------------------------


class KNNClassifier(_Base):
    """Vote of the k nearest training rows; the probability of a class is its share of the votes."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)

    def __init__(self, k: int = 5, **params):
        super().__init__(**params)
        self._set(k=k)

    def _fit(self, dataset: DataFrame) -> "KNNModel":
        model = KNNModel()
        self._copy_shared(model)
        model._set(k=self.getOrDefault("k"))
        path = fresh_path(dataset.sparkSession, "donors")
        donors = dataset.select(
            F.col(self.getOrDefault("idCol")).alias("donor_id"),
            vector_to_array(self.getOrDefault("featuresCol")).alias("vec"),
            F.col(self.getOrDefault("labelCol")).cast("int").alias("label"),
        )
        limit_copies(donors, self.getOrDefault("k")).write.parquet(path)
        model.table = dataset.sparkSession.read.parquet(path)
        model.donor_path = path
        return model


class KNNModel(_Fitted):
    donor_path: str | None = None  # of a model fitted in this session
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    _index: NeighbourIndex | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = self.getOrDefault("featuresCol")
        if self._index is None:
            width = len(self.table.first()["vec"])
            self._index = NeighbourIndex(self.table, width)
        # Equal rows have equal votes: they are asked once, and ids need not be unique.
        vec = vector_to_array(features)
        dataset = dataset.withColumn("_asked", vector_key(vec))
        queries = dataset.select(F.col("_asked").alias("query_id"), vec.alias("vec")).dropDuplicates(["query_id"])
        votes = knn_vote(self._index, queries, self.getOrDefault("k"), self.getOrDefault("numClasses"))
        return (
            dataset.join(votes.withColumnRenamed("query_id", "_asked"), "_asked")
            .withColumn("probability", array_to_vector("votes"))
            .drop("votes", "_asked")
        )


# --- boosted stumps ---------------------------------------------------------------------------


class AdaBoost(_Base):
    """Boosting of depth-1 trees for two or more classes, each round reweighting the rows it gets wrong."""

    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)

    def __init__(self, rounds: int = 100, rate: float = 0.5, **params):
        super().__init__(**params)
        self._set(rounds=rounds, rate=rate)

    def _fit(self, dataset: DataFrame) -> "AdaBoostModel":
        own = {"trees": self.getOrDefault("rounds"), "depth": 1, "rate": self.getOrDefault("rate")}
        grown = _grow(self, dataset, "ada", own)
        stumps = []
        for t in range(grown.rounds):
            feature, cut, value = (a[t] for a in (grown.past.feature, grown.past.cut, grown.past.value))
            if grown.alphas[t, 0]:
                leaves = value[1:3] if feature[0] >= 0 else value[[0, 0]]
                left, right = leaves[:, :-1].argmax(axis=1)
                stumps.append((max(feature[0], 0), cut[0], left, right, grown.alphas[t, 0]))
        if not stumps:
            raise ValueError("no depth-1 tree beats guessing on this table")
        model = AdaBoostModel()
        self._copy_shared(model)
        model._set(stumps=[float(x) for s in stumps for x in s])
        return model


class AdaBoostModel(_Fitted):
    stumps = Param(Params._dummy(), "stumps", "feature, threshold, left, right, weight", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k = self.getOrDefault("numClasses")
        rows = np.array(self.getOrDefault("stumps")).reshape(-1, 5)
        names = ("f", "t", "left", "right", "a")
        table = F.array(
            *[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, row)]) for row in rows]
        )
        x = F.col("_x")

        def votes(c: int):
            def add(acc, s):
                value = F.when(F.element_at(x, s["f"].cast("int") + 1) <= s["t"], s["left"]).otherwise(s["right"])
                return acc + s["a"] * F.when(value == c, 1.0).otherwise(-1.0 / (k - 1))

            return F.aggregate(table, F.lit(0.0), add) / F.lit(float(rows[:, 4].sum()))

        scores = [votes(c) for c in range(k)]
        if k == 2:
            # The published softmax is over the scores of both classes, s and -s.
            one = 1 / (1 + F.exp(F.lit(-2.0) * scores[1]))
            prob = F.array(1 - one, one)
        else:
            exps = [F.exp(s / (k - 1)) for s in scores]
            prob = F.array(*[e / sum(exps[1:], exps[0]) for e in exps])
        out = dataset.withColumn("_x", vector_to_array(self.getOrDefault("featuresCol"))).withColumn("_p", prob)
        return _finish(out).drop("_x")


def _finish(df: DataFrame) -> DataFrame:
    """Probability vector and most probable class (smallest class number on a tie) from array ``_p``."""
    return (
        df.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double"))
        .withColumn("probability", array_to_vector("_p"))
        .drop("_p")
    )


# --- support vectors with a radial kernel ---------------------------------------------------------


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a radial kernel: inner products approximate exp(-gamma |x - y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def __init__(self, gamma=1.0, size=256, seed=42, inputCol="features", outputCol="fourier"):
        super().__init__()
        self._set(gamma=gamma, size=size, seed=seed, inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in ("gamma", "size", "seed"))

        @F.pandas_udf("array<double>")
        def project(vecs: pd.Series) -> pd.Series:
            x = np.vstack([np.asarray(v, dtype=float) for v in vecs])
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, math.sqrt(2 * gamma), (x.shape[1], size))
            b = rng.uniform(0, 2 * math.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(x @ w + b)))

        arr = project(vector_to_array(self.getOrDefault("inputCol")))
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(arr))


class RBFClassifier(_Base):
    """Two-class support vector classifier with a radial kernel and probabilities.

    A machine on random Fourier features of the kernel, its hinge rounded at the corner, and a logistic curve over margins
    of rows the machine has not seen. ``gamma=0`` means 1 / (columns * variance of all entries).
    """

    c = Param(Params._dummy(), "c", "inverse regularisation", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 for scale", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)

    def __init__(self, c: float = 1.0, gamma: float = 0.0, size: int = 256, **params):
        super().__init__(**params)
        self._set(c=c, gamma=gamma, size=size)

    def _fit(self, dataset: DataFrame) -> "RBFModel":
        rows = _rows(self, dataset).persist()
        entries = rows.select(F.explode("x").alias("v"))
        spread = entries.agg(F.var_pop("v").alias("v")).first()["v"]
        spec = Smooth((), 1.0 / self.getOrDefault("c"), True, True, self.getOrDefault("gamma"), self.getOrDefault("size"))
        net = spec.net(0, range(_width(rows)), 2, self.getOrDefault("seed"), spread, 1)
        (machine,) = descent.machines(rows, [net])
        rows.unpersist()
        model = RBFModel()
        self._copy_shared(model)
        numbers = {"gamma": net.lift.gamma, "size": net.lift.size, "seed": net.seed, "columns": len(net.columns)}
        model._set(packed=json.dumps({**numbers, "theta": machine.theta.tolist(), "curve": machine.curve.tolist()}))
        return model


class RBFModel(_Packed):
    def chances(self):
        p = json.loads(self.getOrDefault("packed"))
        lift = descent.Fourier(p["gamma"], p["size"], p["seed"])
        net = descent.Net(0, tuple(range(p["columns"])), 2, loss="hinge", lift=lift, target=1)
        machine = descent.Machine(net, np.array(p["theta"]), np.array(p["curve"]))

        def of(x: np.ndarray) -> np.ndarray:
            one = machine.chance(x)
            return np.stack([1 - one, one], axis=1)

        return of


# --- perceptron ---------------------------------------------------------------------------------------


class Perceptron(_Base):
    """Layers of rectified units with a penalty on squared weights, fitted by L-BFGS over all rows."""

    hidden = Param(Params._dummy(), "hidden", "units per hidden layer", TypeConverters.toListInt)
    penalty = Param(Params._dummy(), "penalty", "weight of half the squared weights", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "passes over the rows", TypeConverters.toInt)

    def __init__(self, hidden=(8,), penalty: float = 1.0, maxIter: int = 200, **params):
        super().__init__(**params)
        self._set(hidden=list(hidden), penalty=penalty, maxIter=maxIter)

    def _fit(self, dataset: DataFrame) -> "PerceptronModel":
        rows = _rows(self, dataset).persist()
        hidden, k = tuple(self.getOrDefault("hidden")), self.getOrDefault("numClasses")
        spec = Smooth(hidden, self.getOrDefault("penalty"), bool(self.getOrDefault("weightCol")), max_iter=self.getOrDefault("maxIter"))
        net = spec.net(0, range(_width(rows)), k, self.getOrDefault("seed"), 1.0)
        (theta,) = descent.minimise(rows, [net])
        rows.unpersist()
        model = PerceptronModel()
        self._copy_shared(model)
        model._set(packed=json.dumps({"columns": len(net.columns), "classes": k, "hidden": hidden, "theta": theta.tolist()}))
        return model


class PerceptronModel(_Packed):
    def chances(self):
        p = json.loads(self.getOrDefault("packed"))
        net = descent.Net(0, tuple(range(p["columns"])), p["classes"], tuple(p["hidden"]))
        theta = np.array(p["theta"])
        return lambda x: net.probabilities(theta, x)


# --- extremely randomised trees --------------------------------------------------------------------


class ExtraTrees(_Base):
    """Trees on all rows whose cuts are drawn per node between the smallest and the largest value there."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "deepest level", TypeConverters.toInt)
    leaf = Param(Params._dummy(), "leaf", "fewest rows of a leaf", TypeConverters.toInt)

    def __init__(self, trees: int = 300, depth: int = 8, leaf: int = 3, **params):
        super().__init__(**params)
        self._set(trees=trees, depth=depth, leaf=leaf)

    def _fit(self, dataset: DataFrame) -> "ExtraTreesModel":
        own = {k: self.getOrDefault(k) for k in ("trees", "depth", "leaf")}
        own |= {"sqrt": True, "weighted": bool(self.getOrDefault("weightCol"))}
        grown = _grow(self, dataset, "extra", own)
        model = ExtraTreesModel()
        self._copy_shared(model)
        model._set(packed=json.dumps({k: v.tolist() for k, v in vars(grown.trees).items()}))
        return model


class ExtraTreesModel(_Packed):
    def chances(self):
        trees = gang.Trees(*[np.array(v) for v in json.loads(self.getOrDefault("packed")).values()])
        grown = gang.Gang([gang.Member(0, (), "extra", len(trees.feature))], self.getOrDefault("numClasses"), {}, {})
        grown.trees = trees
        return lambda x: gang.probabilities(grown, 0, x)


# --- one model per class ---------------------------------------------------------------------------


class PerClass(_Base):
    """One two-class model per class; the probabilities are scaled to sum to 1."""

    def __init__(self, estimator: Estimator | None = None, **params):
        super().__init__(**params)
        self.estimator = estimator

    def copy(self, extra=None):
        out = super().copy(extra)
        out.estimator = self.estimator
        return out

    def _fit(self, dataset: DataFrame) -> "PerClassModel":
        label = self.getOrDefault("labelCol")
        model = PerClassModel()
        self._copy_shared(model)
        estimator = self.estimator
        if self.getOrDefault("weightCol") and estimator.hasParam("weightCol"):
            estimator = estimator.copy({estimator.getParam("weightCol"): self.getOrDefault("weightCol")})
        for c in range(self.getOrDefault("numClasses")):
            binary = dataset.withColumn(label, (F.col(label) == c).cast("double"))
            model.parts.append(estimator.fit(binary))
        return model


class PerClassModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"_one{i}" for i in range(len(self.parts))]
        out = dataset
        for name, part in zip(names, self.parts):
            scored = part.transform(out)
            made = [c for c in scored.columns if c not in out.columns and c != "probability"]
            out = scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", *made)
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        even = F.lit(1.0 / len(names))
        prob = F.array(*[F.when(total > 0, F.col(n) / total).otherwise(even) for n in names])
        return _finish(out.withColumn("_p", prob)).drop(*names)
