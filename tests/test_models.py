import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortspark.ml import explain, selection, zoo
from cohortspark.ml.classifiers import AdaBoost, FourierFeatures, PerClass
from cohortspark.ml.selection import Recipe
from cohortspark.ml.stages import FScoreSelector, KNNImputer, PopulationScaler
from cohortspark.operators.prep import Ratio
from cohortspark.sources import load_model, save_model
from tests.conftest import rows

BINARY = ["Control", "Case"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(120):
        y = int(i % 3 == 0)
        a, b, c = rng.normal() + 2.5 * y + 5, rng.normal() + 5, rng.normal() * 0.1 + 1
        data.append((f"s{i}", f"st{i % 4}", y, a, None if i % 11 == 0 else b, c))
    return spark.createDataFrame(data, "sample_id string, study string, label int, a double, b double, c double").persist()


@pytest.fixture(scope="module")
def recipe():
    return Recipe(features=["a", "b", "c"], classes=BINARY, ratios=[Ratio("ab", "a", "b")], select_k=3)


@pytest.fixture(scope="module")
def whole(samples):
    return samples.na.drop().coalesce(2).persist()


@pytest.fixture(scope="module")
def plain(recipe):
    return Recipe(features=["a", "b", "c"], classes=BINARY, ratios=recipe.ratios, select_k=3, impute=False)


def fit(recipe, df, name, params=None, models=None):
    entry = (models or zoo.binary_models())[name]
    with selection.prepared(recipe, df) as fold:
        return selection.whole_model(fold, selection.fit_on(recipe, entry, fold, params))


SMALL = {
    "LogisticRegression": {},
    "KNN": {},
    "GaussianNB": {},
    "DecisionTree": {},
    "RandomForest": {"trees": 5},
    "ExtraTrees": {"trees": 5},
    "GradientBoosting": {"rounds": 3},
    "AdaBoost": {"rounds": 2},
    "SVC_RBF": {"size": 16},
    "MLP": {"max_iter": 30},
}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_binary_models_learn_and_survive_saving(spark, whole, plain, tmp_path, name):
    check_model(plain, whole, tmp_path, name, 109)


def test_imputing_model_survives_saving(spark, samples, recipe, tmp_path):
    check_model(recipe, samples, tmp_path, "GaussianNB", 120)


def check_model(recipe, samples, tmp_path, name, n):
    model = fit(recipe, samples, name, SMALL[name])
    scored = selection.score(model, samples, ["sample_id", "label"])
    out = scored.collect()
    assert len(out) == n
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["score"] == r["probability"][1] for r in out)
    assert sum(r["prediction"] == r["label"] for r in out) > 0.75 * n
    save_model(model, str(tmp_path / "m"))
    again = {r["sample_id"]: r["score"] for r in selection.score(load_model(str(tmp_path / "m")), samples, ["sample_id"]).collect()}
    assert all(again[r["sample_id"]] == pytest.approx(r["score"], abs=1e-9) for r in out)


@pytest.mark.parametrize("name", ["GradientBoosting", "AdaBoost", "KNN"])
def test_three_classes(spark, name):
    rng = np.random.default_rng(4)
    data = [(i, i % 3, float(rng.normal() + 4 * (i % 3)), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(data, "sample_id int, label int, x double, y double")
    r = Recipe(features=["x", "y"], classes=["A", "B", "C"], ratios=None, impute=False, select_k="all")
    model = fit(r, df, name, {"rounds": 3} if name != "KNN" else {}, zoo.multiclass_models())
    out = selection.score(model, df, ["label"]).collect()
    assert all(len(x["probability"]) == 3 and abs(sum(x["probability"]) - 1) < 1e-9 for x in out)
    assert sum(x["prediction"] == x["label"] for x in out) > 70


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (6.0, 7.0)], "x double, flat double")
    vec = VectorAssembler(inputCols=["x", "flat"], outputCol="assembled").transform(df)
    out = np.array([r["scaled"].toArray() for r in PopulationScaler().fit(vec).transform(vec).collect()])
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(np.sort(out[:, 0]), (x - x.mean()) / x.std()) and np.allclose(out[:, 1], 0)


def test_imputer_falls_back_to_the_mean(spark):
    train = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, 5.0)], "sample_id int, x double, y double")
    out = KNNImputer(["x", "y"], k=2).fit(train).transform(train)
    # Row 3 shares no column with a row that has x, so it gets the mean of x.
    assert rows(out.select("sample_id", "x", "y")) == [(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 2.0, 5.0)]


def test_held_out_values_do_not_reach_the_fit(spark, samples, recipe):
    cut = F.col("study") == "st0"
    inside = samples.where(~cut)
    shifted = samples.withColumn("a", F.when(cut, F.col("a") + 1000).otherwise(F.col("a")))
    entry = zoo.binary_models()["LogisticRegression"]
    found = []
    for table in (samples, shifted):
        with selection.prepared(recipe, table.where(~cut), table.where(cut)) as fold:
            model = selection.fit_on(recipe, entry, fold)
            found.append((fold.steps.stages[-1].stages[0].mean.toArray(), model.stages[-1].coefficients.toArray()))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1])
    assert inside.count() + samples.where(cut).count() == samples.count()


def test_importance_names_follow_the_selection(spark, whole, plain):
    model = fit(plain, whole, "RandomForest", {"trees": 5, "k": 2})
    table = selection.feature_importance(model).collect()
    assert len(table) == 2 and table[0]["feature"] == "a"
    assert selection.feature_importance(fit(plain, whole, "GaussianNB")) is None


def test_screening_reports_a_failing_model(spark, whole, plain):
    def broken(setting, params):
        raise ValueError("no such model")

    models = {"GaussianNB": zoo.binary_models()["GaussianNB"], "Broken": zoo.Entry(broken)}
    board = selection.screen_models(plain, whole, models, folds=2, repeats=1).collect()
    assert [r["name"] for r in board] == ["GaussianNB", "Broken"]
    assert "no such model" in board[1]["error"]
    assert board[0]["overfit_gap"] == pytest.approx(board[0]["train_f1"] - board[0]["cv_f1_mean"])


def test_tuning_without_grid_is_a_plain_fit(spark, whole, plain):
    model, params, best = selection.tune(plain, whole, zoo.binary_models()["GaussianNB"], [2, "all"], 2, 1)
    assert params == {} and best is None and isinstance(model, PipelineModel)


def test_grid_covers_the_feature_counts():
    grid = zoo.binary_models()["RandomForest"].points(zoo.SELECT_GRID)
    assert len(grid) == 2 * 3 * 4 and {g["k"] for g in grid} == {6, 8, 10, "all"}


def test_out_of_fold_scores_every_row_once(spark, samples, recipe):
    oof = selection.out_of_fold(recipe, samples, zoo.binary_models()["GaussianNB"], folds=3)
    assert oof.count() == 120 and oof.select("sample_id").distinct().count() == 120
    assert "InMemoryRelation" not in oof._jdf.queryExecution().toString()  # reads what was written, no fold again


def test_fourier_features_approximate_the_kernel(spark):
    x = np.random.default_rng(6).normal(size=(12, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    df = df.withColumn("features", array_to_vector("v"))
    z = np.array([r["fourier"].toArray() for r in FourierFeatures(0.3, 6000, 1).transform(df).orderBy("i").collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.08


class Linear(Transformer):
    """Scores 0.3 + x - 2 y + 0.5 z, so attributions are known."""

    def _transform(self, dataset):
        s = 0.3 + F.col("x") - 2 * F.col("y") + 0.5 * F.col("z")
        return dataset.withColumn("probability", array_to_vector(F.array(1 - s, s)))


def test_shap_of_a_linear_score(spark):
    data = [(f"r{i}", float(i), float(i % 2), 1.0 - i) for i in range(5)]
    df = spark.createDataFrame(data, "sample_id string, x double, y double, z double")
    back = np.array([[0.0, 1.0, 2.0], [2.0, 3.0, 4.0]]), np.array([0.25, 0.75])
    mean = back[1] @ back[0]
    out = {(r["sample_id"], r["feature"]): r for r in explain.kernel_shap(Linear(), df, ["x", "y", "z"], back).collect()}
    for rid, x, y, z in data:
        for name, value, coef, m in zip("xyz", (x, y, z), (1, -2, 0.5), mean):
            assert out[rid, name]["phi"] == pytest.approx(coef * (value - m))
        assert out[rid, "x"]["base_value"] == pytest.approx(0.3 + mean[0] - 2 * mean[1] + 0.5 * mean[2])


@pytest.mark.parametrize("p,budget", [(2, None), (6, None), (9, 60), (14, 200)])
def test_shapley_operator_is_exact_for_additive_values(p, budget):
    masks, weights = explain.coalitions(p, budget)
    assert weights.sum() == pytest.approx(1.0)
    if budget:
        assert len(masks) <= budget
    op = explain.shapley_operator(masks, weights)
    effects = np.arange(1.0, p + 1)
    values = np.concatenate([masks @ effects, [0.0], [effects.sum()]]) + 3.0
    assert np.allclose(op @ values, effects)


def test_lime_finds_the_driving_feature(spark, whole):
    train = whole
    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), LogisticRegression(regParam=0.01)]
    model = Pipeline(stages=stages).fit(train)
    picked = explain.example_per_class(selection.score(model, train, ["sample_id"]))
    chosen = train.join(picked.select("sample_id"), "sample_id", "left_semi")
    out = explain.lime(model, train, chosen, ["a", "b", "c"], samples=300, num_features=2).collect()
    assert len(out) == 4
    best = {}
    for r in out:
        if abs(r["weight"]) > abs(best.get(r["sample_id"], (0, ""))[0]):
            best[r["sample_id"]] = (r["weight"], r["feature"])
    assert {v[1] for v in best.values()} == {"a"}


def test_centroid_background_is_small_and_weighted(spark, samples):
    centres, weights = explain.centroid_background(samples, ["a", "c"], k=4)
    assert centres.shape == (4, 2) and weights.sum() == pytest.approx(1.0)
    few, w = explain.centroid_background(samples.limit(6), ["a", "c"])
    assert len(few) == 6 and np.allclose(w, 1 / 6)


def test_centroid_background_fills_missing_and_snaps_to_values(spark):
    data = [(float(i % 5), None if i % 2 else 2.0 * (i % 3), None) for i in range(60)]
    df = spark.createDataFrame(data, "x double, y double, empty double")
    centres, weights = explain.centroid_background(df, ["x", "y", "empty"], k=3, few_rows=10)
    assert len(centres) >= 2 and weights.sum() == pytest.approx(1.0)
    assert set(centres[:, 0]) <= {0.0, 1.0, 2.0, 3.0, 4.0} and set(centres[:, 2]) == {0.0}
    mean = np.mean([r[1] for r in data if r[1] is not None])
    assert all(min(abs(v - y) for y in (0.0, 2.0, 4.0, mean)) < 1e-9 for v in centres[:, 1])


def test_selection_follows_f_where_p_values_underflow(spark):
    rng = np.random.default_rng(5)
    n = 20000
    label = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 4)) + label[:, None] * np.array([0.8, 1.2, 9.0, 0.0])
    df = spark.createDataFrame([(float(y), Vectors.dense(r)) for y, r in zip(label, x)], ["label", "scaled"])
    stage = FScoreSelector(1)
    assert stage.fit(df).getIndices() == [2]
    groups = [x[label == c] for c in (0, 1)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (n - 2)
    assert np.allclose(stage.scores(df), between / within)
    assert FScoreSelector(0).fit(df).getIndices() == [0, 1, 2, 3] and FScoreSelector(2).fit(df).getIndices() == [1, 2]


def test_repeated_ids_stay_single_rows_in_the_folds(spark, samples, recipe):
    twice = samples.withColumn("sample_id", F.lit("same"))
    with selection._fold_tables(recipe, twice, 3, 2) as parts:
        n = twice.count()
        assert len(parts) == 6 and all(a.count() + b.count() == n for a, b in parts)
        assert sum(b.count() for _, b in parts[:3]) == n and parts[0][0].columns == twice.columns


def test_per_class_models_get_the_row_weights(spark):
    df = spark.createDataFrame([(float(i % 3), Vectors.dense([i % 3 + 0.1 * (i % 5)]), 1.0 + i % 2) for i in range(60)], ["label", "features", "w"])
    seen = []

    class Spy(LogisticRegression):
        def copy(self, extra=None):
            seen.append({p.name: v for p, v in (extra or {}).items()})
            return super().copy(extra)

    PerClass(Spy(), numClasses=3, weightCol="w").fit(df)
    assert {"weightCol": "w"} in seen


def test_boosted_probability_is_the_softmax_of_both_scores(spark):
    df = spark.createDataFrame([(0.0, Vectors.dense([0.0])), (1.0, Vectors.dense([1.0])), (0.0, Vectors.dense([0.9]))], ["label", "features"])
    model = AdaBoost(rounds=5).fit(df)
    stumps = np.array(model.getOrDefault("stumps")).reshape(-1, 5)
    for r in model.transform(df).collect():
        x = r["features"][0]
        votes = sum(a * (1 if (left if x <= t else right) == 1 else -1) for _, t, left, right, a in stumps) / stumps[:, 4].sum()
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-2 * votes)))


def test_noise_does_not_carry_over_to_unseen_studies(spark):
    rng = np.random.default_rng(12)
    data = [(i, f"s{i % 3}", int(rng.random() < 0.5), float(rng.normal() + 5 * (i % 3))) for i in range(300)]
    df = spark.createDataFrame(data, "sample_id int, study string, label int, x double")
    r = Recipe(features=["x"], classes=BINARY, ratios=None, impute=False, select_k="all")
    report = selection.leave_one_study_out(r, df, zoo.binary_models()["GaussianNB"])
    assert report.count() == 3
    assert abs(selection.mean_study_auc(report).first()[0] - 0.5) < 0.12


def test_imputer_modes(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, None), ("c", 2.1, 10.0), ("d", 9.0, 40.0), ("e", None, 40.0)], "sample_id string, x double, y double")
    fill = lambda mode, k=1: {r["sample_id"]: (r["x"], r["y"]) for r in KNNImputer(["x", "y"], k=k, mode=mode).fit(df).transform(df).collect()}
    assert fill("knn")["b"] == fill("approx")["b"] == (2.0, 10.0)
    assert fill("mean")["b"] == (2.0, 22.75) and fill("median")["b"] == (2.0, 25.0)
    assert fill("median")["e"] == (pytest.approx(2.05), 40.0)
    with pytest.raises(ValueError):
        KNNImputer(["x"], mode="guess")


def test_lime_with_a_feature_nobody_has(spark, whole):
    df = whole.withColumn("blank", F.lit(None).cast("double"))
    stages = [VectorAssembler(inputCols=["a", "c"], outputCol="features"), LogisticRegression()]
    model = Pipeline(stages=stages).fit(df)
    out = explain.lime(model, df, df.limit(2), ["a", "c", "blank"], samples=200).collect()
    assert {r["weight"] for r in out if r["feature"] == "blank"} == {0.0} and len(out) == 6


def test_lime_adds_equal_patterns_up_and_keeps_large_ids(spark, whole):
    big = 2**53 + 1  # no double holds this number
    df = whole.withColumn("sample_id", F.lit(big))
    stages = [VectorAssembler(inputCols=["a", "c"], outputCol="features"), LogisticRegression()]
    model = Pipeline(stages=stages).fit(df)
    out = explain.lime(model, df, df.limit(1), ["a", "c"], samples=200)
    assert {r["sample_id"] for r in out.collect()} == {big}
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()
