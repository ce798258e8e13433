import pytest
from pyspark.sql import functions as F

from cohortspark.operators import draws, evaluate, expect, prep, upstream
from tests.conftest import rows

WIDE = "sample_id string, study string, diagnosis string, x double, y double"


def test_labels_are_stripped_filtered_and_numbered(spark):
    df = spark.createDataFrame(
        [("a", "s", " Case\t", 1.0, 1.0), ("b", "s", "unknown", 1.0, 1.0), ("c", "s", None, 1.0, 1.0), ("d", "s", "Control", 1.0, 1.0)],
        WIDE,
    )
    out = prep.encode_label(prep.known_labels(df, ["Control", "Case"]), ["Control", "Case"])
    assert rows(out.select("sample_id", "diagnosis", "label")) == [("a", "Case", 1), ("d", "Control", 0)]


def test_sites_ignore_case_and_absent_column(spark):
    df = spark.createDataFrame([("a", "Stool"), ("b", "vaginal"), ("c", None)], "sample_id string, sample_type string")
    assert rows(prep.keep_sites(df, ["stool"]).select("sample_id")) == [("a",)]
    assert rows(prep.site_counts(df, ["stool"])) == [(1, 2)]
    assert prep.keep_sites(df.drop("sample_type"), ["stool"]).count() == 3


def test_empty_column_is_no_feature(spark):
    df = spark.createDataFrame([("a", "s", "Case", 1.0, None), ("b", "s", "Case", 2.0, None)], WIDE)
    assert prep.features_of(df) == ["x"]


def test_clip_keeps_missing_and_engineer_is_total(spark):
    df = spark.createDataFrame([(-1.0, None), (2.0, 0.0), (float("nan"), 4.0)], "x double, y double")
    df = prep.missing_to_null(df, ["x", "y"])
    assert rows(prep.clip_features(df, ["x", "y"])) == [(0.0, None), (2.0, 0.0), (None, 4.0)]
    out = prep.engineer(df, ["x", "y"], [prep.Ratio("r", "x", "y"), prep.Ratio("q", "x", "absent")], eps=0.0)
    assert out.columns == ["x", "y", "r"]
    assert rows(out) == [(0.0, 0.0, 0.0), (0.0, 4.0, 0.0), (2.0, 0.0, 0.0)]


def test_engineer_clips_only_named_columns(spark):
    df = spark.createDataFrame([(-1.0, -2.0)], "x double, y double")
    assert rows(prep.engineer(df, ["x", "y"], [], clip_cols=["x"])) == [(0.0, -2.0)]


def test_zscore_without_spread_and_with_missing(spark):
    df = spark.createDataFrame(
        [("a", "s1", "", 1.0, 5.0), ("b", "s1", "", 3.0, 5.0), ("c", "s2", "", None, 1.0), ("d", "s2", "", 2.0, None)], WIDE
    )
    out = rows(prep.zscore_within(df, ["x", "y"]).select("sample_id", "x", "y"))
    assert out == [("a", -1.0, 0.0), ("b", 1.0, 0.0), ("c", None, 0.0), ("d", 0.0, None)]


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, x double")
    b = spark.createDataFrame([(3.0, 4)], "y double, id int")
    assert rows(prep.union_studies([a, b]).select("id", "x", "y")) == [(1, 2.0, None), (4, None, 3.0)]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    total = prep.add_class_weight(df).groupBy("label").agg(F.sum("weight").alias("w"))
    assert all(abs(r["w"] - 2.0) < 1e-12 for r in total.collect())


def test_duplicate_lookup_key_is_refused(spark):
    samples = spark.createDataFrame([("a", "x")], "sample_id string, sample_type string")
    lookup = spark.createDataFrame([("a", "g"), ("a", "h")], "sample_id string, sample_type string")
    with pytest.raises(ValueError, match="not unique"):
        upstream.patch_attribute(samples, lookup, "sample_type")


def test_expectation_without_data_is_left_out(spark):
    found = spark.createDataFrame([("x", "Case"), ("y", "Control")], "feature string, highest_in string")
    want = expect.expectations(spark, [("x", "Control", "strong", ["r"]), ("y", "Control", "weak", []), ("z", "Case", "strong", [])])
    checked = expect.check_expectations(found, want)
    assert rows(checked.select("feature", "matches")) == [("x", False), ("y", True)]
    s = expect.summarise_expectations(checked).first()
    assert (s.n_match, s.n_checked, s.n_high_match, s.n_high, s.high_missed) == (1, 2, 0, 1, ["x"])


def test_rarefy_keeps_depth_and_drops_shallow_samples(spark):
    counts = spark.createDataFrame([("a", "t1", 60), ("a", "t2", 50), ("b", "t1", 9)], "sample_id string, taxon string, reads bigint")
    out = upstream.rarefy(counts, 10)
    assert rows(out.groupBy("sample_id").agg(F.sum("reads"))) == [("a", 10)]
    div = {r["sample_id"]: r["shannon"] for r in upstream.rarefied_shannon(counts, 10).collect()}
    assert div["b"] is None and 0 <= div["a"] <= 1


def test_deep_sample_is_split_without_changing_the_draw(spark, monkeypatch):
    counts = spark.createDataFrame([("a", "t1", 300), ("a", "t2", 200), ("b", "t1", 40)], "sample_id string, taxon string, reads bigint")
    plain = rows(upstream.rarefy(counts, 30))
    for name, value in (("CELLS_PER_TASK", 1), ("HOP_DIGITS", 1)):
        monkeypatch.setattr(draws, name, value)
    assert rows(upstream.rarefy(counts, 30)) == plain


def test_shannon_of_even_counts(spark):
    counts = spark.createDataFrame([("a", f"t{i}", 5) for i in range(8)] + [("b", "t", 3)], "sample_id string, taxon string, reads bigint")
    out = {r["sample_id"]: r["shannon"] for r in upstream.shannon(counts).collect()}
    assert abs(out["a"] - 3) < 1e-12 and abs(out["b"]) < 1e-12


def test_rows_without_study_or_sample_stay(spark):
    df = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 3.0), ("c", None, 5.0), ("d", None, 7.0)], "sample_id string, study string, x double")
    got = rows(prep.zscore_within(df, ["x"]).select("sample_id", "study", "x"))
    assert got == [("a", "s", -1.0), ("b", "s", 1.0), ("c", None, -1.0), ("d", None, 1.0)]
    counts = spark.createDataFrame([("a", "t", 1), (None, "t", 1), (None, "u", 3)], "sample_id string, taxon string, reads bigint")
    assert sorted(r["share"] for r in upstream.relative_abundance(counts).collect()) == [25.0, 75.0, 100.0]
    assert {r["sample_id"] for r in upstream.rarefy(counts, 2).collect()} == {None}


def test_labels_outside_the_declared_classes_do_not_count(spark):
    scored = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (2, 0), (0, -1), (None, 1)], "label int, prediction int")
    got = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(scored, ["A", "B"]).collect()}
    assert got == {("A", "A"): 1, ("A", "B"): 0, ("B", "A"): 0, ("B", "B"): 1}
