"""Check of observed directions against a table of expected directions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTATION_SCHEMA = "feature string, expected string, confidence string, refs array<string>"
# The confidence tiers that count as high.
HIGH_CONFIDENCE = ("strong", "moderate")


def expectations(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), EXPECTATION_SCHEMA)


def check_expectations(comparison: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and found class per feature; an expectation without data is left out.

    Both sides have one row per feature, so the engine picks the join side by their run-time sizes.
    """
    found = comparison.select("feature", F.col("highest_in").alias("found"))
    return expected.join(found, "feature").select(
        "feature",
        "expected",
        "found",
        F.coalesce(F.col("found") == F.col("expected"), F.lit(False)).alias("matches"),
        "confidence",
        "refs",
    )


def summarise_expectations(checked: DataFrame, high=HIGH_CONFIDENCE) -> DataFrame:
    """Match counts over all features and over the high-confidence ones, with the names that miss."""
    is_high = F.col("confidence").isin(*high)
    missed = F.when(is_high & ~F.col("matches"), F.col("feature"))
    return checked.agg(
        F.count_if("matches").alias("n_match"),
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(is_high & F.col("matches")).alias("n_high_match"),
        F.count_if(is_high).alias("n_high"),
        F.array_sort(F.collect_list(missed)).alias("high_missed"),
    )
