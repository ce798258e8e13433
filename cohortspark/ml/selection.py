"""Fits per fold, screening, grid search, out-of-fold scores and held-out studies.

What depends on the fold alone (imputing, ratios, scaling) is prepared for all folds in the same passes, kept in one table
of folds and shared by all models. Searches fit the points of a model side by side in tasks, each over the rows of its fold,
or, where these are too many for a task, in passes over that table which all folds and points share (see ``together``);
models that have no such form are fitted one by one, a few at a time, each by Spark jobs over its fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from statistics import fmean, pstdev
from threading import Lock

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.ml import together
from cohortspark.ml.stages import KNNImputer, PopulationScaler, best_columns, feature_stages, kept_names, select_stage
from cohortspark.ml.zoo import Entry, Setting
from cohortspark.operators import curves, evaluate, splits
from cohortspark.operators.prep import DEFAULT_RATIOS, Ratio, class_weights
from cohortspark.session import cut_lineage, fresh_path, remove

# Fixed value: features kept when the count is not searched.
SELECT_K = 10
PARALLEL_FITS = 4
ROWS_PER_TASK = 10_000


@dataclass
class Recipe:
    """How a sample table becomes a model: columns, feature steps and classes."""

    features: Sequence[str]
    classes: Sequence[str]
    ratios: Sequence[Ratio] | None = DEFAULT_RATIOS
    clip_cols: Sequence[str] | None = None
    impute: bool = True
    impute_mode: str = "knn"
    select_k: int | str = SELECT_K
    id_col: str = "sample_id"
    label_col: str = "label"
    seed: int = splits.SEED
    params: dict = field(default_factory=dict)

    def stages(self) -> list:
        return feature_stages(
            self.features,
            ratios=self.ratios,
            clip_cols=self.clip_cols,
            impute=self.impute,
            id_col=self.id_col,
            impute_mode=self.impute_mode,
        )

    @property
    def score_name(self) -> str:
        return "f1" if len(self.classes) == 2 else "f1_macro"


@dataclass
class Prepared:
    """One training set after the feature stages, with the rows to score."""

    steps: PipelineModel
    train: DataFrame
    test: DataFrame | None
    n_rows: int
    n_features: int


@contextmanager
def prepared(recipe: Recipe, train: DataFrame, test: DataFrame | None = None, temporary: bool = False):
    """Fit the feature stages on ``train`` and keep the prepared rows for the fits inside the block.

    Rows are kept once they are imputed and assembled: what follows is a cheap projection of them. ``temporary`` stages
    are not used after the block, and the donor rows they wrote are deleted.
    """
    *front, scaler = recipe.stages()
    assemble = Pipeline(stages=front).fit(train)
    rows = assemble.transform(train).select(*_keep(recipe, train), "assembled").persist()
    held = None
    if test is not None:
        held = assemble.transform(test).select(*_keep(recipe, test), "assembled").persist()
    try:
        scale = scaler.fit(rows)
        counts = {r[recipe.label_col]: r["n"] for r in class_weights(rows, recipe.label_col).collect()}
        n = sum(counts.values())
        # Iterative fits pay per task and iteration: a small fold takes few tasks, without a shuffle.
        tasks = max(1, min(rows.rdd.getNumPartitions(), -(-n // ROWS_PER_TASK)))
        weight = F.lit(None).cast("double")
        for value, count in counts.items():
            weight = F.when(F.col(recipe.label_col) == value, F.lit(n / (len(counts) * count))).otherwise(weight)
        yield Prepared(
            PipelineModel([*assemble.stages, scale]),
            scale.transform(rows.coalesce(tasks)).withColumn("weight", weight),
            None if held is None else scale.transform(held),
            n,
            scale.stages[0].mean.size,
        )
    finally:
        rows.unpersist()
        if held is not None:
            held.unpersist()
        if temporary:
            for path in {getattr(s, "donor_path", None) for s in assemble.stages} - {None}:
                remove(train.sparkSession, path)


def fit_on(recipe: Recipe, entry: Entry, fold: Prepared, params: dict | None = None) -> PipelineModel:
    """Select features and fit the classifier on a prepared training set."""
    params = dict(params or {})
    k = params.pop("k", recipe.select_k)
    width = fold.n_features if k == "all" else min(int(k), fold.n_features)
    setting = Setting(fold.n_rows, width, len(recipe.classes), recipe.seed, recipe.id_col)
    clf = entry.make(setting, {**recipe.params, **params})
    if entry.weighted and clf.hasParam("weightCol"):
        clf = clf._set(weightCol="weight")
    return Pipeline(stages=[select_stage(k, fold.n_features, recipe.label_col), clf]).fit(fold.train)


def whole_model(fold: Prepared, fitted: PipelineModel) -> PipelineModel:
    return PipelineModel([*fold.steps.stages, *fitted.stages])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Class scores (``probability`` array), the score of the last class and the predicted class."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return out.select(
        *keep,
        F.col("_p").alias("probability"),
        F.element_at("_p", -1).alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def _keep(recipe: Recipe, df: DataFrame) -> list[str]:
    return [c for c in (recipe.id_col, recipe.label_col, "study") if c in df.columns]


def _measure(recipe: Recipe, scored: DataFrame) -> float:
    cm = evaluate.confusion(scored, recipe.classes, recipe.label_col)
    row = evaluate.measures(cm, recipe.classes[-1]).first()
    return float(row[recipe.score_name])


def _each(items: Iterable, work: Callable, parallel: int = PARALLEL_FITS) -> list:
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(work, items))


@contextmanager
def _numbered(recipe: Recipe, train: DataFrame, folds: int, repeats: int):
    """The rows with ``_folds``, their fold of every repeat, so ids need not be unique."""
    numbered = train
    for r in range(repeats):
        numbered = splits.stratified_folds(numbered, recipe.label_col, [recipe.id_col], folds, recipe.seed + r)
        numbered = numbered.withColumnRenamed("fold", f"_fold{r}")
    own = [f"_fold{r}" for r in range(repeats)]
    numbered = numbered.withColumn("_folds", F.array(*own)).drop(*own).persist()
    try:
        yield numbered
    finally:
        numbered.unpersist()


@contextmanager
def _fold_tables(recipe: Recipe, train: DataFrame, folds: int, repeats: int):
    """List of (training rows, held-out rows)."""
    with _numbered(recipe, train, folds, repeats) as numbered:

        def part(r: int, f: int, held: bool) -> DataFrame:
            fold = F.col("_folds")[r]
            return numbered.where(fold == f if held else fold != f).drop("_folds")

        yield [(part(r, f, False), part(r, f, True)) for r in range(repeats) for f in range(folds)]


@dataclass
class Folded:
    """All folds' prepared rows: fold, held, id, rid, label, weight, x. Fold ``whole`` holds every row and holds none out."""

    source: DataFrame
    rows: DataFrame
    path: str
    n_folds: int
    width: int
    n_rows: dict[int, int]
    ranked: dict[int, list[int]]
    moments: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def whole(self) -> int:
        return self.n_folds

    def columns(self, fold: int, k: int | str) -> tuple[int, ...]:
        """The k columns with the best F score on the fold's training rows, in column order."""
        return tuple(sorted(self.ranked[fold][: self.width if k == "all" else int(k)]))

    def spread(self, fold: int, columns: Sequence[int]) -> float:
        """Variance of all entries of the columns."""
        mean, square = (m[list(columns)] for m in self.moments[fold])
        return float(square.mean() - mean.mean() ** 2)

    def part(self, recipe: Recipe, fold: int, held: bool) -> DataFrame:
        mine = self.rows.where((F.col("fold") == fold) & (F.col("held") == held))
        return mine.select(
            F.col("id").alias(recipe.id_col),
            F.col("label").alias(recipe.label_col),
            "weight",
            array_to_vector("x").alias("scaled"),
        ).coalesce(max(1, -(-self.n_rows[fold] // ROWS_PER_TASK)))

    def close(self) -> None:
        self.rows.unpersist()
        remove(self.source.sparkSession, self.path)


def _folded(recipe: Recipe, train: DataFrame, folds: int, repeats: int) -> Folded:
    """Impute, assemble and scale the rows of all folds in the same passes; each fold learns from its training rows only."""
    spark = train.sparkSession
    path, n_folds = fresh_path(spark, "folds"), folds * repeats
    *front, _ = recipe.stages()
    with _numbered(recipe, train, folds, repeats) as numbered:
        fold = F.col("fold")
        own = F.col("_folds")[F.least(F.floor(fold / folds), F.lit(repeats - 1)).cast("int")]
        rows = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds))))
        rows = rows.withColumn("held", (fold < n_folds) & (own == fold % folds)).drop("_folds")
        for stage in front:
            rows = stage.fill_folds(numbered, rows, folds, repeats) if isinstance(stage, KNNImputer) else stage.transform(rows)
        key = F.col(recipe.id_col)
        total = numbered.count() * (n_folds + 1)
        rows.select(
            "fold",
            "held",
            key.alias("id"),
            F.xxhash64(key).alias("rid"),
            F.col(recipe.label_col).cast("int").alias("label"),
            vector_to_array("assembled").alias("v"),
        ).repartition(max(1, -(-total // ROWS_PER_TASK))).write.parquet(path)
    table = spark.read.parquet(path)
    # Columns as prepared() names them: classes of a fold count alike, rows held out count once.
    sizes: dict[int, dict] = {}
    for r in table.where(~F.col("held")).groupBy("fold", "label").count().collect():
        sizes.setdefault(r["fold"], {})[r["label"]] = r["count"]
    weights = [(f, c, sum(of.values()) / (len(of) * n)) for f, of in sizes.items() for c, n in of.items() if c is not None]
    weighted = F.broadcast(spark.createDataFrame(weights, "fold int, label int, _w double"))
    weight = F.when(F.col("held"), F.lit(1.0)).otherwise(F.col("_w"))
    rows = PopulationScaler.scale_folds(table, "v", "x").join(weighted, ["fold", "label"], "left")
    rows = rows.select("fold", "held", "id", "rid", "label", weight.alias("weight"), "x").persist()
    metrics = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("x"))
    per: dict[int, list] = {}
    for r in rows.where(~F.col("held")).groupBy("fold", "label").agg(metrics.alias("s")).collect():
        per.setdefault(r["fold"], []).append((r["s"]["count"], r["s"]["mean"].toArray(), r["s"]["variance"].toArray()))
    n_rows, ranked, moments = {}, {}, {}
    for fold, found in per.items():
        n, mean, var = (np.array(v, dtype=float) for v in zip(*found, strict=True))
        n_rows[fold] = int(n.sum())
        ranked[fold] = best_columns(n[:, None], mean, var)
        share = n[:, None] / n.sum()
        square = var * (n[:, None] - 1) / n[:, None] + mean**2
        moments[fold] = (share * mean).sum(axis=0), (share * square).sum(axis=0)
    return Folded(train, rows, path, n_folds, len(moments[n_folds][0]), n_rows, ranked, moments)


_SHARED: list[dict] = []
_PREPARING = Lock()


@contextmanager
def shared_folds():
    """Searches over the same table and recipe inside the block prepare their folds once."""
    kept: dict = {}
    _SHARED.append(kept)
    try:
        yield
    finally:
        _SHARED.remove(kept)
        for folded in kept.values():
            folded.close()


@contextmanager
def _folds_for(recipe: Recipe, train: DataFrame, folds: int, repeats: int):
    if _SHARED:
        key = (id(train), repr(recipe), folds, repeats)
        with _PREPARING:
            if key not in _SHARED[-1]:
                _SHARED[-1][key] = _folded(recipe, train, folds, repeats)
        yield _SHARED[-1][key]
        return
    folded = _folded(recipe, train, folds, repeats)
    try:
        yield folded
    finally:
        folded.close()


def _in_tasks(recipe: Recipe, folded: Folded, points: dict) -> bool:
    """Whether each fold's fits of these points find room in a task."""
    specs = {name: entry.together({**recipe.params, **params}) for name, (entry, params) in points.items()}
    return together.fits_a_task(specs, max(folded.n_rows.values()), folded.width)


def _together(recipe: Recipe, folded: Folded, points: dict, folds: Sequence[int]) -> dict[tuple, float]:
    """Scores by (point, fold) of points of one model, fitted in shared passes."""
    specs, wanted = {}, {}
    for name, (entry, params) in points.items():
        params = {**recipe.params, **params}
        wanted[name] = params.pop("k", recipe.select_k)
        specs[name] = entry.together(params)
    own = ("fold", "rid", "label", "weight", "x")
    training = folded.rows.where(~F.col("held") & F.col("fold").isin(list(folds))).select(*own)
    columns = lambda fold, name: folded.columns(fold, wanted[name])
    k = len(recipe.classes)
    trees, votes = (isinstance(next(iter(specs.values())), c) for c in (together.Trees, together.Neighbours))
    if _in_tasks(recipe, folded, points):
        if votes:
            jobs = together.vote_jobs(specs, columns, folds)
        elif trees:
            jobs = together.tree_jobs(training, specs, columns, folds, recipe.seed, folded.width)
        else:
            jobs = together.net_jobs(specs, columns, folds, k, recipe.seed, folded.spread)
        rows = folded.rows.select(*own, "held", *(["id"] if votes else []))
        counts = together.confusions_in_tasks(rows, jobs, list(points), k)
        return {at: together.f1(c, recipe.score_name == "f1") for at, c in counts.items()}
    if trees:
        predict = together.predictor_of_trees(training, specs, columns, folds, k, recipe.seed)
    else:
        predict = together.predictor_of_nets(training, specs, columns, folds, k, recipe.seed, folded.spread)
    scored = folded.rows.where(F.col("held") | (F.col("fold") == folded.whole)).where(F.col("fold").isin(list(folds)))
    counts = together.confusions(scored.select(*own), predict, list(points), k)
    return {at: together.f1(c, recipe.score_name == "f1") for at, c in counts.items()}


def _alone(recipe: Recipe, folded: Folded, entry: Entry, params: dict, fold: int) -> float:
    """Score of one point on one fold by a fit of its own."""
    train = folded.part(recipe, fold, False)
    test = train if fold == folded.whole else folded.part(recipe, fold, True)
    model = fit_on(recipe, entry, Prepared(None, train, test, folded.n_rows[fold], folded.width), params)
    try:
        return _measure(recipe, score(model, test, [recipe.id_col, recipe.label_col]))
    finally:
        for path in {getattr(s, "donor_path", None) for s in model.stages} - {None}:
            remove(train.sparkSession, path)


def _cv_scores(recipe: Recipe, folded: Folded, points: dict, on_train: bool) -> tuple[dict, dict, dict]:
    """Fold scores of every named (entry, params) point, its score on all training rows, and the first error of a point."""
    folds = [*range(folded.n_folds), *([folded.whole] if on_train else [])]
    groups: dict[int, dict] = {}
    for name, point in points.items():
        groups.setdefault(id(point[0]), {})[name] = point
    found: dict[tuple, float] = {}
    errors: dict = {}

    def fail(names, exc):
        for name in names:
            errors.setdefault(name, f"{type(exc).__name__}: {exc}")

    def shared(group):
        try:
            found.update(_together(recipe, folded, group, folds))
        except Exception as exc:  # noqa: BLE001 - a failing model is reported, the others go on
            fail(group, exc)

    def single(at):
        name, (entry, params), fold = at
        if name not in errors:
            try:
                found[name, fold] = _alone(recipe, folded, entry, params, fold)
            except Exception as exc:  # noqa: BLE001
                fail([name], exc)

    # Neighbours have no passes: a fold that does not fit a task is searched by its own jobs.
    in_passes = [
        g for g in groups.values()
        if (entry := next(iter(g.values()))[0]).together is not None and (not entry.only_in_tasks or _in_tasks(recipe, folded, g))
    ]
    rest = [(n, p, f) for g in groups.values() if g not in in_passes for n, p in g.items() for f in folds]
    # Passes wait for the slowest task, so the models' passes overlap; fits one by one fill the gaps.
    with ThreadPoolExecutor(max_workers=max(1, len(in_passes))) as pool:
        waiting = [pool.submit(shared, g) for g in in_passes]
        _each(rest, single)
        for w in waiting:
            w.result()
    scores = {n: [found[n, f] for f in range(folded.n_folds)] for n in points if n not in errors}
    return scores, {n: found[n, folded.whole] for n in scores if on_train}, errors


LEADERBOARD_SCHEMA = (
    "name string, cv_f1_mean double, cv_f1_std double, train_f1 double, overfit_gap double, error string"
)


def screen_models(
    recipe: Recipe,
    train: DataFrame,
    models: dict[str, Entry],
    folds: int = splits.FOLDS,
    repeats: int = splits.REPEATS,
) -> DataFrame:
    """Leaderboard of the models by repeated cross-validation, best first.

    ``overfit_gap`` is the score on the training rows minus the mean fold score. A model that fails
    keeps its error text and comes last.
    """
    points = {name: (entry, {}) for name, entry in models.items()}
    with _folds_for(recipe, train, folds, repeats) as folded:
        scores, on_train, errors = _cv_scores(recipe, folded, points, True)
    rows = []
    for name in models:
        if name in errors:
            rows.append((name, None, None, None, None, errors[name]))
        else:
            mean = fmean(scores[name])
            rows.append((name, mean, pstdev(scores[name]), on_train[name], on_train[name] - mean, None))
    board = train.sparkSession.createDataFrame(rows, LEADERBOARD_SCHEMA)
    return board.orderBy(F.col("cv_f1_mean").desc_nulls_last(), "name")


def grid_scores(
    recipe: Recipe,
    train: DataFrame,
    entry: Entry,
    select: list | None = None,
    folds: int = splits.FOLDS,
    repeats: int = splits.REPEATS,
) -> tuple[list[dict], list[float]]:
    """Parameter points of a model and their mean fold scores, in grid order."""
    grid = entry.points(select)
    points = {i: (entry, params) for i, params in enumerate(grid)}
    with _folds_for(recipe, train, folds, repeats) as folded:
        scores, _, errors = _cv_scores(recipe, folded, points, False)
    if errors:
        raise RuntimeError(f"grid points failed: {errors}")
    return grid, [fmean(scores[i]) for i in points]


def tune(
    recipe: Recipe,
    train: DataFrame,
    entry: Entry,
    select: list | None = None,
    folds: int = splits.FOLDS,
    repeats: int = splits.REPEATS,
) -> tuple[PipelineModel, dict, float | None]:
    """Best model of a grid search refitted on all rows; without a grid a plain fit and no score."""
    grid, best = entry.points(select), None
    params: dict = {}
    if grid:
        grid, means = grid_scores(recipe, train, entry, select, folds, repeats)
        best = max(means)
        params = grid[means.index(best)]
    with prepared(recipe, train) as fold:
        model = whole_model(fold, fit_on(recipe, entry, fold, params))
    return model, params, best


def out_of_fold(
    recipe: Recipe,
    train: DataFrame,
    entry: Entry,
    params: dict | None = None,
    folds: int = splits.FOLDS,
) -> DataFrame:
    """Score of every row by a model that has not seen it. Scores are written once, while the folds are still cached."""

    def one(part):
        inside, outside = part
        with prepared(recipe, inside) as fold:
            model = whole_model(fold, fit_on(recipe, entry, fold, params))
        return model, outside

    with _fold_tables(recipe, train, folds, 1) as parts:
        return _scores(recipe, _each(parts, one))


def _scores(recipe: Recipe, models: Sequence[tuple[PipelineModel, DataFrame]]) -> DataFrame:
    """Scores of each model on its rows, written once; the donor rows that the models hold are deleted."""
    scored = reduce(DataFrame.unionByName, [score(m, rows, _keep(recipe, rows)) for m, rows in models])
    try:
        return cut_lineage(scored)
    finally:
        for path in {getattr(s, "donor_path", None) for m, _ in models for s in m.stages} - {None}:
            remove(scored.sparkSession, path)


def leave_one_study_out(
    recipe: Recipe, df: DataFrame, entry: Entry, params: dict | None = None
) -> DataFrame:
    """Score every usable study by a model trained on all other studies.

    One row per study: rows, AUC, balanced accuracy at 0.5. Studies that leave one class only on
    either side are skipped.
    """
    usable = splits.study_folds(df, "study", recipe.label_col).where("usable")
    studies = [r["study"] for r in usable.select("study").orderBy("study").collect()]

    def one(study):
        with prepared(recipe, df.where(F.col("study") != study)) as fold:
            model = whole_model(fold, fit_on(recipe, entry, fold, params))
        return model, df.where(F.col("study") == study)

    parts = _each(studies, one)
    if not parts:
        return df.sparkSession.createDataFrame([], "study string, n_test bigint, auc double, balanced_accuracy double")
    return study_report(_scores(recipe, parts), recipe.classes, recipe.label_col)


def study_report(scored: DataFrame, classes: Sequence[str], label_col: str = "label") -> DataFrame:
    """AUC and balanced accuracy at 0.5 per study, from one table of scores."""
    cut = curves.apply_threshold(scored, curves.DEFAULT_CUT)
    bal = evaluate.measures(
        evaluate.confusion(cut, classes, label_col, keys=["study"]), classes[-1], ["study"]
    ).select("study", F.col("n").alias("n_test"), "balanced_accuracy")
    return bal.join(curves.auc(scored, "score", label_col, ["study"]), "study").select(
        "study", "n_test", "auc", "balanced_accuracy"
    )


def mean_study_auc(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("auc").alias("mean_cross_study_auc"))


def generalisation_gap(random_auc: DataFrame, report: DataFrame) -> DataFrame:
    """AUC on a random split next to the mean AUC on unseen studies."""
    left = random_auc.select(F.lit("random_split").alias("evaluation"), "auc")
    right = mean_study_auc(report).select(
        F.lit("unseen_study").alias("evaluation"), F.col("mean_cross_study_auc").alias("auc")
    )
    return left.unionByName(right)


def learning_curve(
    recipe: Recipe,
    train: DataFrame,
    entry: Entry,
    params: dict | None = None,
    fractions: Sequence[float] = (0.3, 0.475, 0.65, 0.825, 1.0),
    folds: int = splits.FOLDS,
) -> DataFrame:
    """Training and held-out score by training size, averaged over folds."""
    folded = splits.stratified_folds(train, recipe.label_col, [recipe.id_col], folds, recipe.seed).persist()
    sets = splits.learning_curve_sets(folded, fractions, [recipe.id_col], folds, recipe.seed).persist()

    def point(at):
        f, fraction = at
        held = folded.where(F.col("fold") == f)
        inside = sets.where((F.col("holdout_fold") == f) & (F.col("share") <= fraction + 1e-9))
        with prepared(recipe, inside, held) as fold:
            model = fit_on(recipe, entry, fold, params)
            on_train = _measure(recipe, score(model, fold.train, _keep(recipe, fold.train)))
            on_test = _measure(recipe, score(model, fold.test, _keep(recipe, fold.test)))
            return float(fraction), fold.n_rows, on_train, on_test

    rows = _each([(f, x) for f in range(folds) for x in fractions], point)
    sets.unpersist()
    folded.unpersist()
    points = train.sparkSession.createDataFrame(
        rows, "fraction double, n_train bigint, train_score double, cv_score double"
    )
    return points.groupBy("fraction").agg(
        F.min("n_train").alias("n_train"), F.avg("train_score").alias("train_score"), F.avg("cv_score").alias("cv_score")
    )


def feature_importance(model: PipelineModel) -> DataFrame | None:
    """Tree importances or mean absolute coefficients by column name; None for other models."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        values = clf.featureImportances.toArray()
    elif hasattr(clf, "coefficientMatrix"):
        values = abs(clf.coefficientMatrix.toArray()).mean(axis=0)
    else:
        return None
    names = kept_names(model)
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )
