import json
import os

import numpy as np

from cohortspark.ml import zoo
from cohortspark.operators.expect import expectations
from cohortspark.operators.prep import Ratio
from cohortspark.plans.report import RunOptions, run


def small_models(names):
    models = zoo.binary_models()
    return {n: models[n] for n in names}


def test_whole_run_writes_reports_model_and_summary(spark, tmp_path):
    rng = np.random.default_rng(20)
    data = []
    for i in range(90):
        y = int(rng.random() < 0.4)
        site = "Stool" if i % 10 else "vaginal"
        data.append(
            (f"s{i}", f"st{i % 2}", ["Control ", "Case"][y], site, float(rng.normal() + 2 * y + 6), float(rng.random() + 1), None)
        )
    df = spark.createDataFrame(data, "sample_id string, study string, diagnosis string, sample_type string, x double, y double, blank double")
    out = str(tmp_path / "out")
    tables = run(
        df,
        ["Control", "Case"],
        out,
        expectations=expectations(spark, [("x", "Case", "strong", ["r1"])]),
        recipe_options={"ratios": [Ratio("xy", "x", "y")], "select_k": "all", "impute": False},
        options=RunOptions(
            sites=["stool"], zscore=["y"], models=small_models(["GaussianNB", "DecisionTree"]), select_grid=None,
            folds=2, repeats=1, policy="youden", lime_samples=100,
        ),
    )
    assert {"batch_markers", "expectation_check", "leaderboard", "test_measures", "held_out_studies", "shap_importance", "lime"} <= set(tables)
    assert os.path.isdir(f"{out}/model") and os.path.isdir(f"{out}/reports/batch_markers")
    [part] = [f for f in os.listdir(f"{out}/summary") if f.startswith("part-")]
    summary = json.loads(open(f"{out}/summary/{part}").read())
    assert summary["n_samples"] == 81 and summary["classes"] == ["Control", "Case"]
    assert summary["batch_markers"]["n_features_total"] == 2
    assert set(summary["mean_abs_shap"]) == {"x", "y"}
    assert len(summary["test_measures"]) == 2 and summary["best_model"]["name"] in {"GaussianNB", "DecisionTree"}


def test_three_class_run(spark, tmp_path):
    rng = np.random.default_rng(21)
    names = ["Control", "A", "B"]
    data = [(i, names[i % 3], float(rng.normal() + 3 * (i % 3)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(data, "sample_id int, diagnosis string, x double, y double")
    models = {"GaussianNB": zoo.multiclass_models()["GaussianNB"]}
    tables = run(
        df, names, str(tmp_path / "out"), recipe_options={"ratios": None, "select_k": "all", "impute": False},
        options=RunOptions(models=models, folds=2, repeats=1),
    )
    assert tables["test_auc"].count() == 3 and tables["shap_importance"].first()["feature"] == "x"
    assert "f1_macro" in tables["test_measures"].columns
