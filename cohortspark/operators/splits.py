"""Hold-out, k-fold, repeated and leave-one-study-out splits that depend on row keys only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ranks import hash_position
from cohortspark.session import sized

# Seed, hold-out share, folds and repeats of the published runs.
SEED = 42
TEST_SIZE = 0.2
FOLDS = 5
REPEATS = 5


def holdout_sizes(df: DataFrame, label_col: str = "label", test_size: float = TEST_SIZE) -> DataFrame:
    """Hold-out rows per class: ceil(share * n) rows spread by largest remainder, ties by class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    everyone = Window.partitionBy(F.lit(1))
    quota = counts.withColumn("_total", F.sum("n_class").over(everyone)).withColumn(
        "_test", F.ceil(F.col("_total") * F.lit(test_size))
    )
    share = F.col("_test") * F.col("n_class") / F.col("_total")
    placed = quota.withColumn("_base", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 9))
    # One row per class: these windows run over the class table, never over samples.
    order = everyone.orderBy(F.col("_rest").desc(), F.col(label_col).asc())
    spare = F.col("_test") - F.sum("_base").over(everyone)
    given = F.col("_base") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    return placed.select(label_col, "n_class", given.cast("bigint").alias("n_test"))


def stratified_holdout(
    df: DataFrame,
    label_col: str = "label",
    ids: Sequence[str] = ("sample_id",),
    seed: int = SEED,
    test_size: float = TEST_SIZE,
) -> DataFrame:
    """Add ``is_test``; every class keeps its share in the hold-out part."""
    placed = hash_position(df, [label_col], ids, seed)
    return (
        placed.join(sized(holdout_sizes(df, label_col, test_size)), label_col)
        .withColumn("is_test", F.col("position") <= F.col("n_test"))
        .drop("position", "n_class", "n_test")
    )


def stratified_folds(
    df: DataFrame,
    label_col: str = "label",
    ids: Sequence[str] = ("sample_id",),
    folds: int = FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``fold`` (0..folds-1); the folds of a class differ by one row at most."""
    placed = hash_position(df, [label_col], ids, seed)
    return placed.withColumn("fold", ((F.col("position") - 1) % folds).cast("int")).drop("position")


def repeated_folds(
    df: DataFrame,
    label_col: str = "label",
    ids: Sequence[str] = ("sample_id",),
    folds: int = FOLDS,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Long form (ids, label, repeat, fold): every repeat shuffles with its own seed."""
    narrow = df.select(*ids, label_col).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    placed = hash_position(narrow, ["repeat", label_col], ids, F.col("repeat") + seed)
    return placed.select(
        *ids, label_col, "repeat", ((F.col("position") - 1) % folds).cast("int").alias("fold")
    )


def study_folds(df: DataFrame, study_col: str = "study", label_col: str = "label") -> DataFrame:
    """Studies usable as a held-out set: both sides of the split must hold two classes.

    One row per study with the row count and class counts of the study and of its complement.
    """
    per = df.groupBy(study_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    inside = per.groupBy(study_col).agg(
        F.sum("n").alias("n_test"), F.count(F.lit(1)).alias("test_classes"), F.collect_set(label_col).alias("_set")
    )
    # A class is absent from the complement when this study holds all of its rows.
    overall = (
        per.groupBy(label_col)
        .agg(F.sum("n").alias("_n_all"))
        .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    )
    only_here = (
        per.join(overall, label_col)
        .groupBy(study_col)
        .agg(F.count_if(F.col("n") == F.col("_n_all")).alias("_owned"), F.max("_k").alias("_k"))
    )
    return (
        inside.join(only_here, study_col)
        .withColumn("train_classes", F.col("_k") - F.col("_owned"))
        .withColumn("usable", (F.col("test_classes") >= 2) & (F.col("train_classes") >= 2))
        .select(study_col, "n_test", "test_classes", "train_classes", "usable")
    )


def learning_curve_sets(
    folded: DataFrame,
    fractions: Sequence[float],
    ids: Sequence[str] = ("sample_id",),
    folds: int = FOLDS,
    seed: int = SEED,
    fold_col: str = "fold",
) -> DataFrame:
    """Add ``holdout_fold`` and ``share``: a row trains for that fold at every fraction >= its share.

    The training sets of one fold are nested prefixes of one hash order.
    """
    train = folded.withColumn("holdout_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(
        F.col(fold_col) != F.col("holdout_fold")
    )
    placed = hash_position(train, ["holdout_fold"], ids, seed, size="_n")
    sizes = F.array(*[F.lit(float(f)) for f in sorted(fractions)])
    first = F.try_element_at(
        F.filter(sizes, lambda f: F.col("position") <= F.floor(f * F.col("_n") + F.lit(1e-9))), F.lit(1)
    )
    return placed.withColumn("share", first).drop("position", "_n")
