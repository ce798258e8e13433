"""Report bundles and the end-to-end run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.ml import explain, selection
from cohortspark.ml.selection import Recipe
from cohortspark.ml.stages import kept_names
from cohortspark.ml.zoo import SELECT_GRID, Entry, binary_models, multiclass_models
from cohortspark.operators import curves, evaluate, expect, prep, splits, stats
from cohortspark.sources import save_model, write_json, write_report


def profile(df: DataFrame, features: Sequence[str], classes: Sequence[str]) -> dict[str, DataFrame]:
    """Class balance, missing values and correlation."""
    return {
        "class_counts": stats.class_counts(df, classes),
        "missingness": stats.missingness(df, features),
        "correlation": stats.correlation(df, features),
    }


def comparison(df: DataFrame, features: Sequence[str], classes: Sequence[str]) -> dict[str, DataFrame]:
    """Group comparison and the same means in long form."""
    table = stats.group_comparison(df, features, classes)
    return {"group_comparison": table, "group_means": stats.group_means_long(table, classes)}


def confounding(df: DataFrame, classes: Sequence[str]) -> dict[str, DataFrame]:
    """Study by class table, single-class studies and what study membership alone predicts."""
    return {
        "study_crosstab": stats.study_crosstab(df, classes),
        "single_class_studies": stats.single_class_studies(df),
        "study_auc_floor": stats.study_auc_floor(df, classes[-1]),
    }

# Fixed value: repeats of the published run with three classes.
MULTICLASS_REPEATS = 3


@dataclass
class RunOptions:
    sites: Sequence[str] | None = None
    zscore: Sequence[str] = ()
    non_features: Sequence[str] = prep.NON_FEATURE_COLS
    policy: str = "f1"
    models: dict[str, Entry] | None = None
    select_grid: Sequence | None = tuple(SELECT_GRID)
    folds: int = splits.FOLDS
    repeats: int | None = None  # as published: 5 for two classes, 3 for more
    held_out_studies: bool = True
    explain_rows: bool = True
    lime_samples: int = 5000


def run(
    samples: DataFrame,
    classes: Sequence[str],
    out_dir: str,
    *,
    expectations: DataFrame | None = None,
    recipe_options: dict | None = None,
    options: RunOptions | None = None,
) -> dict[str, DataFrame]:
    """Whole study: clean, profile, compare, screen, tune, choose a cut, evaluate, explain, write.

    Returns the report tables; they are also written below ``out_dir`` with the model and a summary.
    """
    opt = options or RunOptions()
    spark = samples.sparkSession
    df = prep.known_labels(samples, classes)
    if opt.sites is not None:
        df = prep.keep_sites(df, opt.sites)
    df = prep.missing_to_null(df, prep.numeric_features(df, opt.non_features))
    df = prep.drop_empty_columns(df, prep.numeric_features(df, opt.non_features))
    features = prep.numeric_features(df, (*opt.non_features, "label"))
    if opt.zscore:
        df = prep.zscore_within(df, [c for c in opt.zscore if c in features])
    df = prep.encode_label(df, classes).persist()

    tables: dict[str, DataFrame] = {}
    tables |= confounding(df, classes) if "study" in df.columns else {}
    tables |= profile(df, features, classes)
    tables |= comparison(df, features, classes)
    binary = len(classes) == 2
    if binary and "study" in df.columns:
        tables["batch_markers"] = stats.batch_markers(df, features, classes[-1])
    if expectations is not None:
        tables["expectation_check"] = expect.check_expectations(tables["group_comparison"], expectations)
        tables["expectation_summary"] = expect.summarise_expectations(tables["expectation_check"])

    # Published recipe for more than two classes: no ratios, no clipping, no selection.
    usual = {} if binary else {"ratios": None, "select_k": "all"}
    recipe = Recipe(features=features, classes=classes, **(usual | (recipe_options or {})))
    split = splits.stratified_holdout(df).persist()
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    models = opt.models or (binary_models() if binary else multiclass_models())
    repeats = opt.repeats or (splits.REPEATS if binary else MULTICLASS_REPEATS)
    board = selection.screen_models(recipe, train, models, opt.folds, repeats)
    tables["leaderboard"] = board
    best = board.first()
    entry = models[best["name"]]
    grid = list(opt.select_grid) if binary and opt.select_grid else None
    model, params, tuned = selection.tune(recipe, train, entry, grid, opt.folds, repeats)

    cut = curves.DEFAULT_CUT
    if binary:
        oof = selection.out_of_fold(recipe, train, entry, params, opt.folds).persist()
        cut = curves.choose_threshold(oof, opt.policy)
        tables["out_of_fold"] = oof
    keep = [c for c in (recipe.id_col, recipe.label_col, "study") if c in test.columns]
    scored = selection.score(model, test, keep).persist()
    cm = evaluate.confusion(scored, classes)
    if binary:
        tables["test_measures"] = evaluate.evaluate_cuts(
            scored, classes, {"default": curves.DEFAULT_CUT, "tuned": cut}
        )
        tuned_scores = curves.apply_threshold(scored, cut)
        cm = evaluate.confusion(tuned_scores, classes)
        tables["roc_points"] = curves.roc_points(scored)
        tables["test_auc"] = curves.auc(scored)
    else:
        tables["test_measures"] = evaluate.measures(cm, classes[-1])
        tables["test_auc"] = curves.ovr_auc(scored, classes)
    tables["confusion"] = cm
    tables["class_report"] = evaluate.class_report(cm)
    tables["learning_curve"] = selection.learning_curve(recipe, train, entry, params, folds=opt.folds)
    importance = selection.feature_importance(model)
    if importance is not None:
        tables["importance"] = importance
    if binary and opt.held_out_studies and "study" in df.columns:
        report = selection.leave_one_study_out(recipe, df, entry)
        tables["held_out_studies"] = report
        tables["generalisation_gap"] = selection.generalisation_gap(tables["test_auc"], report)
    if opt.explain_rows:
        tables |= explanations(recipe, model, train, test, opt.lime_samples)

    for name, table in tables.items():
        if any(f.dataType.typeName() == "array" for f in table.schema.fields if f.name == "probability"):
            write_json(table, f"{out_dir}/reports/{name}")
        else:
            write_report(table, f"{out_dir}/reports/{name}")
    save_model(model, f"{out_dir}/model")
    best_row = (best["name"], {k: str(v) for k, v in params.items()}, tuned, best["cv_f1_mean"], best["overfit_gap"])
    write_json(summary(spark, df, tables, classes, best_row, cut), f"{out_dir}/summary")
    for cached in (split, df):
        cached.unpersist()
    return tables


def prepared_columns(model: PipelineModel, df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns the classifier of a fitted pipeline sees, one by one, next to the kept ones."""
    ready = PipelineModel(model.stages[:-1]).transform(df).select(*keep, vector_to_array("features").alias("_v"))
    return ready.select(*keep, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])


def explanations(
    recipe: Recipe, model: PipelineModel, train: DataFrame, test: DataFrame, lime_samples: int
) -> dict[str, DataFrame]:
    """Shapley attributions of the test rows, and for two classes a local fit per predicted class.

    Two classes: of the raw features by the whole model. More classes: of the prepared features by the classifier alone.
    """
    features = list(recipe.features)
    if len(recipe.classes) == 2:
        background = explain.centroid_background(train, features)
        wanted = [1]
    else:
        names, classifier = kept_names(model), model.stages[-1]
        train, test = (prepared_columns(model, df, names, [recipe.id_col]) for df in (train, test))
        model = PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), classifier])
        features = names
        background = explain.sampled_background(train, features, id_col=recipe.id_col)
        wanted = list(range(len(recipe.classes)))
    shap = explain.kernel_shap(model, test, features, background, classes=wanted)
    out = {"shap_values": shap, "shap_importance": explain.shap_importance(shap)}
    if len(recipe.classes) == 2:
        scored = selection.score(model, test, [recipe.id_col])
        picked = explain.example_per_class(scored, recipe.id_col)
        rows = test.join(picked.select(recipe.id_col), recipe.id_col, "left_semi")
        out["lime"] = explain.lime(model, train, rows, features, samples=lime_samples)
    return out


def summary(
    spark, df: DataFrame, tables: dict[str, DataFrame], classes: Sequence[str], best: tuple, cut: float
) -> DataFrame:
    """One nested row that sums the run up. Every part is a table of a few rows."""
    name, params, tuned, screened, gap = best
    one = df.agg(F.count(F.lit(1)).alias("n_samples"))
    one = one.withColumns(
        {
            "classes": F.array(*[F.lit(c) for c in classes]),
            "class_counts": _as_map(tables["class_counts"], "diagnosis", "n", "bigint"),
            "best_model": F.struct(
                F.lit(name).alias("name"),
                _literal_map(params).alias("tuned_params"),
                F.lit(tuned).cast("double").alias("tuned_cv_score"),
                F.lit(screened).alias("screen_cv_score"),
                F.lit(gap).alias("overfit_gap"),
            ),
            "decision_threshold": F.round(F.lit(cut), 4),
            "highest_in": _as_map(tables["group_comparison"], "feature", "highest_in", "string"),
        }
    )
    if "study_crosstab" in tables:
        counts = stats.study_counts(df)
        one = one.withColumn("studies_combined", _as_map(counts, "study", "n", "bigint"))
    if "shap_importance" in tables:
        one = one.withColumn(
            "mean_abs_shap", _as_map(tables["shap_importance"], "feature", "mean_abs_shap", "double")
        )
    for key in ("test_measures", "test_auc", "class_report", "held_out_studies"):
        if key in tables:
            rows = [r.asDict() for r in tables[key].collect()]
            fields = tables[key].schema
            value = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in rows])
            one = one.withColumn(key, value)
    if "batch_markers" in tables:
        b = stats.batch_summary(tables["batch_markers"]).first()
        one = one.withColumn(
            "batch_markers",
            F.struct(
                F.lit(b["n_study_dominated"]).alias("n_features_study_dominated"),
                F.lit(b["n_features"]).alias("n_features_total"),
                F.array(*[F.lit(x) for x in b["severe"]]).cast("array<string>").alias("severe"),
            ),
        )
    return one


def _as_map(table: DataFrame, key: str, value: str, kind: str):
    """Map literal from a table with one row per feature, class or study."""
    pairs = [x for r in table.select(key, value).collect() for x in (F.lit(r[key]), F.lit(r[value]).cast(kind))]
    return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{kind}>")


def _literal_map(values: dict[str, str]):
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs).cast("map<string,string>")
