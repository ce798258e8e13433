import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.operators import curves, prep, ranks, splits, stats
from cohortspark.session import join_counted, join_salted
from tests.conftest import rows

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.tuples(st.integers(-5, 5), st.booleans()), min_size=4, max_size=30)


def table(spark, pairs):
    data = [(i, "Case" if y else "Control", int(y), float(x)) for i, (x, y) in enumerate(pairs)]
    return spark.createDataFrame(data, "sample_id int, diagnosis string, label int, x double")


def brute_auc(pairs):
    pos, neg = [x for x, y in pairs if y], [x for x, y in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@FEW
@given(VALUES)
def test_auc_equals_pair_counting_and_survives_monotone_maps(spark, pairs):
    df = table(spark, pairs)
    want = brute_auc(pairs)
    got = curves.auc(df, "x").first()["auc"]
    mapped = curves.auc(df.withColumn("x", F.exp("x") * 3), "x").first()["auc"]
    if want is None:
        assert got is None and mapped is None
    else:
        assert got == pytest.approx(want, abs=1e-12) and mapped == pytest.approx(want, abs=1e-12)
        sym = stats.feature_auc(df, ["x"], F.col("label") == 1).first()["auc"]
        assert sym == pytest.approx(max(want, 1 - want), abs=1e-12)


@FEW
@given(VALUES)
def test_u_statistics_add_up(spark, pairs):
    df = table(spark, pairs)
    a = stats.mann_whitney(df, ["x"], ["Control", "Case"]).first()
    b = stats.mann_whitney(df, ["x"], ["Case", "Control"]).first()
    if a["n1"] and a["n2"]:
        assert a["u1"] + b["u1"] == pytest.approx(a["n1"] * a["n2"])
        assert a["mannwhitney_p"] == pytest.approx(b["mannwhitney_p"])
    else:
        assert a["u1"] is None and a["mannwhitney_p"] is None


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_ranks_do_not_depend_on_buckets(spark, bits):
    rng = np.random.default_rng(1)
    # One value holds a third of the rows.
    values = np.where(rng.random(600) < 1 / 3, 0.0, rng.normal(size=600).round(2))
    long = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    ties = ranks.tie_groups(long, ["feature"], "value")
    got = {r["value"]: r["avg_rank"] for r in ranks.rank_groups(ties, ["feature"], "value", long=long, bits=bits).collect()}
    for v in set(values):
        assert got[v] == (values < v).sum() + ((values == v).sum() + 1) / 2


def test_exact_p_value():
    # 3 against 3 rows, complete separation: 2 of the 20 arrangements are as extreme.
    assert 2 * stats.exact_u_tail(3, 3, 9) == pytest.approx(0.1)
    assert stats.exact_u_tail(2, 4, 0) == pytest.approx(1.0)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 9), (2, 5), (3, 8), (4, 4), (5, 6)])
def test_exact_p_value_counts_all_arrangements(n1, n2):
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        assert stats.exact_u_tail(n1, n2, u) == pytest.approx(sum(x >= u for x in us) / len(us), rel=1e-12)


def test_exact_p_value_at_any_size():
    for n in (1000, 1001, 10**6, 10**12):
        assert 2 * stats.exact_u_tail(2, n, 2 * n) == pytest.approx(2 / math.comb(n + 2, 2))
    n = 10**7  # the normal approximation with 8 rows is good to a few percent near two deviations
    mean, s = 4 * n, math.sqrt(8 * n * (n + 9) / 12)
    assert stats.exact_u_tail(8, n, mean + 2 * s) == pytest.approx(0.5 * math.erfc(2 / math.sqrt(2)), rel=0.1)


def test_mann_whitney_small_constant_and_tied(spark):
    df = spark.createDataFrame(
        [("Control", 1.0, 7.0, 1.0)] * 1 + [("Control", 2.0, 7.0, 1.0), ("Control", 3.0, 7.0, 2.0)]
        + [("Case", 4.0, 7.0, 2.0), ("Case", 5.0, 7.0, 3.0), ("Case", 6.0, 7.0, 3.0)],
        "diagnosis string, sep double, flat double, tied double",
    )
    p = {r["feature"]: r["mannwhitney_p"] for r in stats.mann_whitney(df, ["sep", "flat", "tied"], ["Control", "Case"]).collect()}
    assert p["sep"] == pytest.approx(0.1)
    assert p["flat"] == 1.0
    u, mu, s = 8.5, 4.5, math.sqrt(9 / 12 * (7 - 18 / 30))
    assert p["tied"] == pytest.approx(math.erfc((u - mu - 0.5) / s / math.sqrt(2)))


def test_batch_markers_need_two_studies(spark):
    df = spark.createDataFrame([("s", "Case", 1.0), ("s", "Control", 2.0)], "study string, diagnosis string, x double")
    assert stats.batch_markers(df, ["x"], "Case").count() == 0


def test_batch_marker_tiers(spark):
    data = [("s1" if i < 50 else "s2", "Case" if i % 2 else "Control", float(i), 1.0 * (i % 2), None) for i in range(100)]
    df = spark.createDataFrame(data, "study string, diagnosis string, barcode double, signal double, blank double")
    out = {r["feature"]: r for r in stats.batch_markers(df, ["barcode", "signal"], "Case").collect()}
    assert out["barcode"]["auc_predicts_study"] == 1.0 and out["barcode"]["risk"] == "SEVERE"
    assert out["barcode"]["batch_dominated"] and not out["signal"]["batch_dominated"]
    assert out["signal"]["auc_predicts_study"] == 0.5 and out["signal"]["risk"] == ""


def test_correlation_with_missing_nan_and_constant(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) + 100
    data = [(float(a), (None, math.nan)[i % 2] if i % 7 == 0 else float(b), float(a + b), 4.0, 1e9 + 1e-9 * i) for i, (a, b, _) in enumerate(x)]
    for extra in (0, 30):  # the same rules whatever the number of columns
        names = ["a", "b", "c", "flat", "nearly", *[f"x{k}" for k in range(extra)]]
        df = spark.createDataFrame([(*r, *[float(r[0]) for _ in range(extra)]) for r in data], ", ".join(f"{n} double" for n in names))
        got = {(r[0], r[1]): r[2] for r in stats.correlation(df, names).collect()}
        assert len(got) == len(names) ** 2
        rows_ = [r for r in data if r[1] is not None and not math.isnan(r[1])]
        want = np.corrcoef([r[0] for r in rows_], [r[1] for r in rows_])[0, 1]
        assert got["a", "b"] == pytest.approx(want, abs=1e-9) and got["b", "a"] == pytest.approx(want, abs=1e-9)
        assert got["a", "flat"] is None and got["flat", "flat"] is None and got["a", "a"] == pytest.approx(1.0)


def test_highest_class_tie_goes_to_first_declared(spark):
    df = spark.createDataFrame([("B", 1.0), ("A", 1.0)], "diagnosis string, x double")
    assert stats.group_means(df, ["x"], ["B", "A"]).first()["highest_in"] == "B"


@pytest.mark.parametrize("n", [11, 91, 129, 720])
def test_folds_partition_and_stratify(spark, n):
    df = spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    folds = splits.stratified_folds(df)
    assert folds.count() == n
    sizes = folds.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)
    test = splits.stratified_holdout(df).where("is_test")
    assert test.count() == math.ceil(0.2 * n)


def test_holdout_sizes_of_the_published_runs(spark):
    for classes, want in [((34, 57), (7, 12)), ((69, 60), (14, 12)), ((344, 140, 236), (69, 28, 47))]:
        df = spark.createDataFrame([(i,) for i, n in enumerate(classes) for _ in range(n)], "label int")
        got = {r["label"]: r["n_test"] for r in splits.holdout_sizes(df).collect()}
        assert tuple(got[i] for i in range(len(classes))) == want


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(200).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert rows(splits.stratified_folds(df.repartition(7))) == rows(splits.stratified_folds(df.coalesce(1)))


def test_learning_sets_are_nested_and_exclude_the_fold(spark):
    df = spark.range(60).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"))
    sets = splits.learning_curve_sets(splits.stratified_folds(df), (0.5, 1.0))
    assert sets.where("fold = holdout_fold").count() == 0
    assert rows(sets.groupBy("share").count()) == [(0.5, 120), (1.0, 120)]


def scored(spark, pairs):
    return spark.createDataFrame([(float(s), y) for s, y in pairs], "score double, label int")


def test_thresholds(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.3, 0), (0.2, 0)])
    assert curves.choose_threshold(df, "f1") == 0.6
    assert curves.choose_threshold(df, "youden") == 0.6
    assert curves.choose_threshold(df, "f2") == 0.6
    assert curves.choose_threshold(df, "sensitivity") == 0.6
    assert curves.choose_threshold(df, "fixed") == 0.5


def test_threshold_defaults(spark):
    upside_down = scored(spark, [(0.1, 1), (0.9, 0)])
    assert curves.threshold_youden(upside_down).first()["threshold"] == 0.5
    assert curves.threshold_sensitivity(scored(spark, [(0.4, 0)])).first()["threshold"] == 0.5


def test_roc_is_monotone(spark):
    rng = np.random.default_rng(5)
    df = scored(spark, [(round(float(s), 2), int(s + rng.normal() * 0.3 > 0.5)) for s in rng.random(300)])
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in curves.roc_points(df).collect())[::-1]
    for (_, f0, t0), (_, f1, t1) in zip(pts, pts[1:]):
        assert f1 >= f0 and t1 >= t0
    assert pts[-1][1:] == (1.0, 1.0)


@pytest.mark.parametrize("n", [1, 4, 37])
def test_percentiles_match_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n).round(1)
    long = spark.createDataFrame([("f", float(v)) for v in x] + [("f", None)], "feature string, value double")
    got = ranks.percentiles(long, ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    assert np.allclose([got["q1"], got["q2"], got["q3"]], np.percentile(x, [25, 50, 75]))


def test_missing_values_have_no_rank(spark):
    long = spark.createDataFrame([("f", 1, 2.0), ("f", 2, None), ("f", 3, 2.0)], "feature string, id int, value double")
    out = ranks.average_rank(long, ["feature"], "value")
    assert rows(out.select("id", "avg_rank")) == [(1, 1.5), (2, None), (3, 1.5)]


def test_long_form_keeps_missing_rows(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id int, x double, y double")
    assert rows(prep.to_long(df, ["id"], ["x", "y"])) == [(1, "x", 1.0), (1, "y", None)]


def test_hot_keys_join_apart_with_the_same_result(spark):
    big = spark.createDataFrame([("h", i) for i in range(30)] + [("a", 1), ("b", 2)], "key string, x int")
    side = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    apart = join_counted(big, side, ["key"], "n", hot_rows=10)
    assert rows(apart) == rows(big.join(side, "key")) and apart.count() == 32
    assert rows(join_salted(big, side, ["key"], "x", salts=4)) == rows(apart)
