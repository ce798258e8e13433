"""Feature stages. Each is fitted on training rows only, so nothing leaks from held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.ml.saving import CompositeModel
from cohortspark.operators.neighbours import NeighbourIndex, limit_copies, vector_key, with_nan
from cohortspark.operators.prep import DEFAULT_RATIOS, EPS, Ratio, engineer, to_long
from cohortspark.operators.ranks import percentiles
from cohortspark.session import cut_lineage, fresh_path

# Fixed value: donors per missing cell.
NEIGHBOURS = 5


class _ImputerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to fill", TypeConverters.toListString)
    idCol = Param(Params._dummy(), "idCol", "unique row key", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "donors per missing cell", TypeConverters.toInt)
    mode = Param(Params._dummy(), "mode", "knn, approx, mean or median", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)


class KNNImputer(Estimator, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill a missing cell with the mean of that column over the k nearest training rows that have it.

    Falls back to the training mean where no training row can be compared. Other modes, by name: ``approx`` looks at one
    block of donors near the row instead of all that may hold a neighbour (for tables with so many columns that no block
    can be ruled out), ``mean`` and ``median`` fill with that number of the training column.
    """

    def __init__(self, inputCols: Sequence[str] = (), idCol: str = "sample_id", k: int = NEIGHBOURS, mode: str = "knn"):
        super().__init__()
        if mode not in ("knn", "approx", "mean", "median"):
            raise ValueError(f"unknown mode {mode!r}")
        self._set(inputCols=list(inputCols), idCol=idCol, k=k, mode=mode)

    def _fit(self, dataset: DataFrame) -> "KNNImputerModel":
        cols, key = self.getOrDefault("inputCols"), self.getOrDefault("idCol")
        mode = self.getOrDefault("mode")
        if mode == "median":
            middle = percentiles(to_long(dataset, [], cols).where("value IS NOT NULL"), ["feature"], "value", {"m": 0.5}, n_groups=len(cols))
            means = {r["feature"]: r["m"] for r in middle.collect()}
        else:
            means = dataset.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
        model = KNNImputerModel()
        model._set(
            inputCols=cols,
            idCol=key,
            k=self.getOrDefault("k"),
            mode=mode,
            means=[float("nan") if means.get(c) is None else float(means[c]) for c in cols],
        )
        if mode in ("mean", "median"):
            return model
        # Donors are kept as a table: every later use reads the same rows, also after a lost executor.
        path = fresh_path(dataset.sparkSession, "donors")
        donors = dataset.select(F.col(key).alias("donor_id"), with_nan(cols).alias("vec"))
        limit_copies(donors, self.getOrDefault("k")).write.parquet(path)
        model.table = dataset.sparkSession.read.parquet(path)
        model.donor_path = path
        return model

    def fill_folds(self, numbered: DataFrame, every: DataFrame, folds: int, repeats: int) -> DataFrame:
        """Fill every fold's rows as a fit on its training rows would, for all folds in the same passes.

        ``numbered`` has ``_folds``, a row's fold of every repeat; ``every`` has its rows once per fold of each repeat and
        once for the whole table, in this order numbered by ``fold``, and tells by ``held`` which are not trained on.
        """
        cols, mode, k = self.getOrDefault("inputCols"), self.getOrDefault("mode"), self.getOrDefault("k")
        spark, inside = numbered.sparkSession, every.where(~F.col("held"))
        filled = {c: F.col(c).cast("double") for c in cols}
        gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        if numbered.where(gap).isEmpty():
            return every.withColumns(filled)
        n_sets = folds * repeats + 1
        middle: dict[int, list] = {}
        if mode == "median":
            long = to_long(inside, ["fold"], cols).where("value IS NOT NULL")
            for r in percentiles(long, ["fold", "feature"], "value", {"m": 0.5}, n_groups=n_sets * len(cols)).collect():
                middle.setdefault(r["fold"], [None] * len(cols))[cols.index(r["feature"])] = r["m"]
        else:
            for r in inside.groupBy("fold").agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(cols)]).collect():
                middle[r["fold"]] = [r[f"m{j}"] for j in range(len(cols))]
        nan = float("nan")
        rows = [(f, [nan if m is None else float(m) for m in middle.get(f, [None] * len(cols))]) for f in range(n_sets)]
        means = F.broadcast(spark.createDataFrame(rows, "fold int, _means array<double>"))
        if mode in ("mean", "median"):
            out = every.join(means, "fold")
            return out.withColumns({c: F.coalesce(filled[c], F.col("_means")[j]) for j, c in enumerate(cols)}).drop("_means")
        donors = numbered.select(F.col(self.getOrDefault("idCol")).alias("donor_id"), with_nan(cols).alias("vec"), "_folds")
        index = NeighbourIndex(cut_lineage(limit_copies(donors, k, ["vec", "_folds"])), len(cols))
        asked = vector_key(with_nan(cols))
        queries = numbered.where(gap).select(asked.alias("query_id"), with_nan(cols).alias("vec")).dropDuplicates(["query_id"])
        near = index.join(queries, k, target_missing=True, approximate=mode == "approx", folds=(folds, repeats))
        column, fold = F.col("target") % len(cols), F.floor(F.col("target") / len(cols)).cast("int")
        fills = near.groupBy(F.col("query_id").alias("_asked"), fold.alias("fold")).agg(
            *[F.avg(F.when(column == j, F.col("value"))).alias(f"_f{j}") for j in range(len(cols))]
        )
        holed = every.where(gap).withColumn("_asked", asked).join(fills, ["_asked", "fold"], "left").join(means, "fold")
        patched = holed.withColumns({c: F.coalesce(filled[c], f"_f{j}", F.col("_means")[j]) for j, c in enumerate(cols)})
        return every.where(~gap).withColumns(filled).unionByName(patched.select(*every.columns))


class KNNImputerModel(CompositeModel, _ImputerParams):
    _index: NeighbourIndex | None = None
    donor_path: str | None = None  # of a model fitted in this session

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getOrDefault("inputCols")
        if self.table is None:
            fills = zip(cols, self.getOrDefault("means"))
            return dataset.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in fills})
        gap = F.lit(False)
        for c in cols:
            gap = gap | F.col(c).isNull()
        if dataset.where(gap).isEmpty():
            return dataset.withColumns({c: F.col(c).cast("double") for c in cols})
        if self._index is None:
            self._index = NeighbourIndex(self.table, len(cols))
        # Only rows with a gap look for neighbours; the others pass without a shuffle.
        # Equal rows have equal fills: they are asked once, and ids need not be unique.
        holed = dataset.where(gap).withColumn("_asked", vector_key(with_nan(cols)))
        near = self._index.join(
            holed.select(F.col("_asked").alias("query_id"), with_nan(cols).alias("vec")).dropDuplicates(["query_id"]),
            self.getOrDefault("k"),
            target_missing=True,
            approximate=self.getOrDefault("mode") == "approx",
        )
        fills = near.groupBy(F.col("query_id").alias("_asked")).agg(
            *[F.avg(F.when(F.col("target") == j, F.col("value"))).alias(f"_f{j}") for j in range(len(cols))]
        )
        means = self.getOrDefault("means")
        filled = (
            holed.join(fills, "_asked", "left")
            .withColumns({c: F.coalesce(c, f"_f{j}", F.lit(means[j])) for j, c in enumerate(cols)})
            .select(*dataset.columns)
        )
        whole = dataset.where(~gap).withColumns({c: F.col(c).cast("double") for c in cols})
        return whole.unionByName(filled.withColumns({c: F.col(c).cast("double") for c in cols}))


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Clip, add ratios, replace non-finite numbers; keeps no state."""

    features = Param(Params._dummy(), "features", "input columns", TypeConverters.toListString)
    ratios = Param(Params._dummy(), "ratios", "flat list of name, numerator, denominator", TypeConverters.toListString)
    eps = Param(Params._dummy(), "eps", "added to divisors", TypeConverters.toFloat)
    clipCols = Param(Params._dummy(), "clipCols", "columns clipped at zero", TypeConverters.toListString)

    def __init__(
        self,
        features: Sequence[str] = (),
        ratios: Sequence[Ratio] = DEFAULT_RATIOS,
        eps: float = EPS,
        clipCols: Sequence[str] | None = None,
    ):
        super().__init__()
        self._set(
            features=list(features),
            ratios=[x for r in ratios for x in r],
            eps=eps,
            clipCols=list(features if clipCols is None else clipCols),
        )

    def specs(self) -> list[Ratio]:
        flat = self.getOrDefault("ratios")
        return [Ratio(*flat[i : i + 3]) for i in range(0, len(flat), 3)]

    def outputs(self) -> list[str]:
        """Features after this stage: a ratio is there only when both of its inputs are."""
        have = set(self.getOrDefault("features"))
        return [*self.getOrDefault("features"), *[
            s.name for s in self.specs() if s.numerator in have and s.denominator in have
        ]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        feats = self.getOrDefault("features")
        usable = [s for s in self.specs() if s.name in self.outputs()]
        return engineer(dataset, feats, usable, self.getOrDefault("eps"), self.getOrDefault("clipCols"))


class PopulationScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise a vector column with the population deviation; a constant column becomes 0.

    The fitted form is two built-in stages: the standard scaler divides by the sample deviation, and
    an element-wise factor of sqrt(n / (n - 1)) turns that into the population deviation.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "scaled vector column", TypeConverters.toString)

    def __init__(self, inputCol: str = "assembled", outputCol: str = "scaled"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        source, out = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        middle = f"{out}_sample"
        scaler = StandardScaler(inputCol=source, outputCol=middle, withMean=True, withStd=True).fit(dataset)
        n = dataset.count()
        factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
        widen = ElementwiseProduct(
            inputCol=middle, outputCol=out, scalingVec=Vectors.dense([factor] * scaler.mean.size)
        )
        return PipelineModel([scaler, widen])

    @staticmethod
    def scale_folds(rows: DataFrame, vec: str, out: str) -> DataFrame:
        """Standardise the array ``vec`` by the rows of each ``fold`` that are not ``held``, for all folds in one pass."""
        summary = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(vec))
        scales = []
        for r in rows.where(~F.col("held")).groupBy("fold").agg(summary.alias("s")).collect():
            n, mean, std = r["s"]["count"], r["s"]["mean"].toArray(), r["s"]["std"].toArray()
            inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
            scales.append((r["fold"], mean.tolist(), inverse.tolist(), float(np.sqrt(n / (n - 1))) if n > 1 else 1.0))
        table = rows.sparkSession.createDataFrame(scales, "fold int, _mean array<double>, _inverse array<double>, _widen double")
        scaled = F.zip_with(F.zip_with(vec, "_mean", lambda v, m: v - m), "_inverse", lambda v, s: v * s)
        widened = F.transform(scaled, lambda v: v * F.col("_widen"))
        return rows.join(F.broadcast(table), "fold").withColumn(out, widened).drop("_mean", "_inverse", "_widen")


def feature_stages(
    features: Sequence[str],
    *,
    ratios: Sequence[Ratio] | None = DEFAULT_RATIOS,
    clip_cols: Sequence[str] | None = None,
    impute: bool = True,
    id_col: str = "sample_id",
    neighbours: int = NEIGHBOURS,
    impute_mode: str = "knn",
) -> list:
    """Impute -> engineer -> assemble -> scale; ``ratios=None`` leaves the engineering step out."""
    stages: list = []
    if impute:
        stages.append(KNNImputer(features, id_col, neighbours, impute_mode))
    names = list(features)
    if ratios is not None:
        step = FeatureEngineer(features, ratios, clipCols=clip_cols)
        stages.append(step)
        names = step.outputs()
    stages.append(VectorAssembler(inputCols=names, outputCol="assembled"))
    stages.append(PopulationScaler("assembled", "scaled"))
    return stages


class FScoreSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the ``k`` columns of a vector with the largest one-way ANOVA F score, in column order.

    Ranked by F itself: p-values underflow to 0 for every useful column of a large table. Ties go to the first column;
    a column whose F is undefined comes last. ``k=0`` keeps every column.
    """

    k = Param(Params._dummy(), "k", "columns to keep, 0 for all", TypeConverters.toInt)
    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column of the kept ones", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class number", TypeConverters.toString)

    def __init__(self, k: int = 0, inputCol: str = "scaled", outputCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._set(k=k, inputCol=inputCol, outputCol=outputCol, labelCol=labelCol)

    def scores(self, dataset: DataFrame) -> np.ndarray:
        """F of every column, from count, mean and variance per class (one row per class reaches the driver)."""
        summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.getOrDefault("inputCol")))
        rows = dataset.groupBy(self.getOrDefault("labelCol")).agg(summary.alias("s")).collect()
        n = np.array([r["s"]["count"] for r in rows], dtype=float)[:, None]
        mean = np.array([r["s"]["mean"].toArray() for r in rows])
        var = np.array([r["s"]["variance"].toArray() for r in rows])
        return f_scores(n, mean, var)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        f = self.scores(dataset)
        order = _by_score(f)[: self.getOrDefault("k") or len(f)]
        return VectorSlicer(
            inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"), indices=sorted(order)
        )


def f_scores(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """One-way F of every column from counts (class, 1), means and variances (class, column)."""
    grand = (n * mean).sum(axis=0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (n * (mean - grand) ** 2).sum(axis=0) / (len(n) - 1)
        return between / (((n - 1) * var).sum(axis=0) / (n.sum() - len(n)))


def _by_score(f: np.ndarray) -> list[int]:
    return [int(j) for j in np.argsort(-np.where(np.isnan(f), -np.inf, f), kind="stable")]


def best_columns(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> list[int]:
    """Columns by falling F; ties go to the first column, a column whose F is undefined comes last."""
    return _by_score(f_scores(n, mean, var))


def select_stage(k: int | str, n_features: int, label_col: str = "label") -> FScoreSelector:
    """Keep the k features with the best ANOVA F score; ``"all"`` keeps every one, in column order."""
    return FScoreSelector(0 if k == "all" else min(int(k), n_features), labelCol=label_col)


def kept_names(model: PipelineModel) -> list[str]:
    """Names of the columns the classifier sees, read off the fitted stages themselves."""
    names: list[str] = []
    for stage in _flat(model):
        if isinstance(stage, VectorAssembler):
            names = stage.getInputCols()
        elif isinstance(stage, VectorSlicer):
            names = [names[i] for i in stage.getIndices()]
    return names


def _flat(model) -> list:
    return [s for stage in model.stages for s in (_flat(stage) if isinstance(stage, PipelineModel) else [stage])]
