"""Counts, missingness, correlation, group comparison, rank tests and batch-marker checks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.prep import to_long
from cohortspark.operators.ranks import rank_groups, tie_groups

# Limits of the risk tiers and of significance.
SEVERE_AUC = 0.90
HIGH_AUC = 0.75
ALPHA = 0.05


# --- counts -----------------------------------------------------------------------------------


def class_counts(df: DataFrame, classes: Sequence[str], label_col: str = "diagnosis") -> DataFrame:
    """Rows per declared class, in declared order, with 0 for a class without rows."""
    spark = df.sparkSession
    declared = spark.createDataFrame(list(enumerate(classes)), f"class_index int, {label_col} string")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counts, label_col, "left").select(
        label_col, "class_index", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def present_classes(df: DataFrame, classes: Sequence[str], label_col: str = "diagnosis") -> DataFrame:
    """Declared classes that occur, with their declared position."""
    return class_counts(df, classes, label_col).where("n > 0").select(label_col, "class_index")


def study_counts(df: DataFrame, study_col: str = "study") -> DataFrame:
    return df.groupBy(study_col).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, the missing value being one of them."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def study_crosstab(
    df: DataFrame, classes: Sequence[str], study_col: str = "study", label_col: str = "diagnosis"
) -> DataFrame:
    return (
        df.groupBy(study_col).pivot(label_col, list(classes)).agg(F.count(F.lit(1))).na.fill(0, list(classes))
    )


def single_class_studies(df: DataFrame, study_col: str = "study", label_col: str = "diagnosis") -> DataFrame:
    """Studies whose rows all carry one class: study and class cannot be told apart there."""
    per = df.groupBy(study_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy(study_col)
        .agg(F.count(F.lit(1)).alias("_k"), F.min(label_col).alias("only_class"), F.sum("n").alias("n"))
        .where("_k = 1")
        .drop("_k")
    )


def study_auc_floor(
    df: DataFrame, positive: str, study_col: str = "study", label_col: str = "diagnosis"
) -> DataFrame:
    """AUC with which membership in each study alone predicts the class (0.5 = no confounding).

    A study whose indicator or class is constant has no value.
    """
    per = df.groupBy(study_col).agg(
        F.count_if(F.col(label_col) == positive).alias("pos_in"), F.count(F.lit(1)).alias("n_in")
    )
    whole = df.agg(F.count_if(F.col(label_col) == positive).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    totals = per.withColumns({"_pos": F.lit(whole["pos"]), "_neg": F.lit(whole["n"] - whole["pos"])})
    p1 = F.col("pos_in") / F.nullif(F.col("_pos"), F.lit(0))
    p0 = (F.col("n_in") - F.col("pos_in")) / F.nullif(F.col("_neg"), F.lit(0))
    auc = p1 * (1 - p0) + F.lit(0.5) * (p1 * p0 + (1 - p1) * (1 - p0))
    defined = F.col("n_in") < F.col("_pos") + F.col("_neg")
    return totals.withColumn("_a", F.when(defined, auc)).select(
        study_col, "n_in", F.greatest(F.col("_a"), 1 - F.col("_a")).alias("study_auc")
    )


# --- profiles ---------------------------------------------------------------------------------


def missingness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of missing values per feature in percent, for the features that miss any, largest first."""
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in features])
    return (
        wide.unpivot([], list(features), "feature", "missing_pct")
        .where("missing_pct > 0")
        .orderBy(F.col("missing_pct").desc(), "feature")
    )


# A column counts as constant when its variance over the rows of a pair is below this part of its mean square there,
# both taken about the mean of the whole column.
CONSTANT = 1e-12


def correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair over the rows that hold both; constant -> missing.

    NaN counts as missing. Each task reduces its rows to masked Gram matrices, which are added up by pair.
    """
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features])
    names = list(features)
    # Shifting by the column means keeps the sums of squares well conditioned.
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in names])
    p = len(names)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        seen = False
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
            seen = True
        if seen:
            i, j = np.indices((p, p))
            yield pd.DataFrame(
                {
                    "i": i.ravel().astype("int32"),
                    "j": j.ravel().astype("int32"),
                    "n": n.ravel(),
                    "sx": sx.ravel(),
                    "sy": sx.T.ravel(),
                    "sxx": sxx.ravel(),
                    "syy": sxx.T.ravel(),
                    "sxy": sxy.ravel(),
                }
            )

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = df.select(*[F.col(c).cast("double") for c in names]).mapInPandas(
        reduce_rows, "i int, j int, " + ", ".join(f"{s} double" for s in sums)
    )
    total = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    floor = F.lit(CONSTANT)
    spread = F.when((vx > floor * F.col("sxx")) & (vy > floor * F.col("syy")), F.sqrt(vx * vy))
    labels = F.array(*[F.lit(c) for c in names])
    return total.select(
        F.element_at(labels, F.col("i") + 1).alias("feature_x"),
        F.element_at(labels, F.col("j") + 1).alias("feature_y"),
        (cov / spread).alias("r"),
    )


# --- group comparison -------------------------------------------------------------------------


def group_means(
    df: DataFrame, features: Sequence[str], classes: Sequence[str], label_col: str = "diagnosis"
) -> DataFrame:
    """Mean of every feature per class (one column per class) and the class with the highest mean.

    Ties go to the class declared first. One aggregate per class over the wide rows; the transposed
    table has one row per feature.
    """
    per_class = df.groupBy(label_col).agg(*[F.avg(c).alias(c) for c in features])
    means = (
        per_class.unpivot([label_col], list(features), "feature", "mean")
        .groupBy("feature")
        .pivot(label_col, list(classes))
        .agg(F.max("mean"))
    )
    return means.withColumn("highest_in", _highest(classes))


def _highest(classes: Sequence[str]) -> Column:
    top = F.greatest(*[F.col(f"`{c}`") for c in classes]) if len(classes) > 1 else F.col(f"`{classes[0]}`")
    out = F.lit(None).cast("string")
    for c in reversed(classes):
        out = F.when(F.col(f"`{c}`") == top, F.lit(c)).otherwise(out)
    return out


def group_means_long(means: DataFrame, classes: Sequence[str], label_col: str = "diagnosis") -> DataFrame:
    """The same means as (feature, class, mean) rows."""
    return means.unpivot(["feature"], list(classes), label_col, "mean")


def mann_whitney(
    df: DataFrame, features: Sequence[str], classes: Sequence[str], label_col: str = "diagnosis"
) -> DataFrame:
    """Two-sided Mann-Whitney test of two classes for every feature.

    ``u1`` belongs to the first class; ``z`` uses the tie-corrected deviation and the continuity
    correction; ``mannwhitney_p`` is exact for a small class without ties, else normal. A feature that
    misses one class on all rows has no result; one that is constant gets p = 1.
    """
    first, second = classes
    long = to_long(df.where(F.col(label_col).isin(first, second)), [label_col], features)
    ties = tie_groups(long, ["feature"], "value", {"n1": F.col(label_col) == first})
    ranked = rank_groups(ties, ["feature"], "value", long=long, n_groups=len(features))
    return _p_values(_u_statistics(ranked))


def _u_statistics(ranked: DataFrame) -> DataFrame:
    t = F.col("n").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum("n").cast("double").alias("_n"),
        F.sum("n1").cast("double").alias("_n1"),
        F.sum(F.col("n1") * F.col("avg_rank")).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"),
        F.max("n").alias("_max_tie"),
    )
    n, n1 = F.col("_n"), F.col("_n1")
    n2 = n - n1
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    both = (n1 > 0) & (n2 > 0)
    s2 = n1 * n2 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    base = sums.select(
        "feature",
        n1.cast("bigint").alias("n1"),
        n2.cast("bigint").alias("n2"),
        (F.col("_max_tie") > 1).alias("has_ties"),
        F.when(both, u1).alias("u1"),
        F.when(both & (s2 > 0), F.sqrt(s2)).alias("_s"),
    )
    u_max = F.greatest(F.col("u1"), F.col("n1") * F.col("n2") - F.col("u1"))
    mean = F.col("n1") * F.col("n2") / F.lit(2.0)
    return base.withColumn("z", (u_max - mean - F.lit(0.5)) / F.col("_s")).drop("_s")


# Fixed value: the published test is exact up to this many rows in the smaller class, whatever the other one has.
EXACT_SMALL = 8


@cache
def _partition_numerator(parts: tuple[int, ...], period: int) -> list[int]:
    """Product of (1 - q^period) / (1 - q^part): the generating function of partitions over (1 - q^period)^len."""
    poly = [1]
    for part in parts:
        grown = poly + [0] * (period - part)
        # Times (1 - q^period) / (1 - q^part) = 1 + q^part + ... + q^(period - part).
        out = grown[:]
        for k in range(part, len(out)):
            out[k] += out[k - part]
            if k >= period and k - period < len(poly):
                out[k] -= poly[k - period]
        poly = out
    return poly


def _partitions(x: int, parts: tuple[int, ...]) -> int:
    """Ways to write x as a sum of the parts (repetition allowed, order ignored): a quasi-polynomial in x."""
    if x < 0:
        return 0
    period = math.lcm(*parts)
    top = _partition_numerator(parts, period)
    return sum(
        top[j] * math.comb((x - j) // period + len(parts) - 1, len(parts) - 1)
        for j in range(x % period, min(x, len(top) - 1) + 1, period)
    )


def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties, in exact integers and in the same work for any size of the larger class.

    The arrangements with a given U are the coefficients of a Gaussian binomial; expanding its numerator
    gives at most 2^(smaller class) partition counts. By symmetry the upper tail is a lower one.
    """
    small, large = sorted((int(n1), int(n2)))
    most = small * large - math.ceil(u)
    parts = (1, *range(1, small + 1))  # the second 1 adds up the coefficients
    ways = sum(
        (-1) ** r * _partitions(most - r * large - sum(chosen), parts)
        for r in range(small + 1)
        for chosen in combinations(range(1, small + 1), r)
    )
    return ways / math.comb(small + large, small)


def _p_values(stats: DataFrame) -> DataFrame:
    """Spark has no error function; the input has one row per feature."""

    def add_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n1, n2, ties, u1, z in zip(pdf["n1"], pdf["n2"], pdf["has_ties"], pdf["u1"], pdf["z"]):
                if n1 == 0 or n2 == 0:
                    out.append(None)
                elif not ties and min(n1, n2) <= EXACT_SMALL:
                    out.append(min(1.0, 2 * exact_u_tail(n1, n2, max(u1, n1 * n2 - u1))))
                elif pd.isna(z):
                    out.append(1.0)
                else:
                    out.append(min(1.0, math.erfc(z / math.sqrt(2))))
            pdf["mannwhitney_p"] = pd.Series(out, index=pdf.index, dtype=float)
            yield pdf

    fields = "feature string, n1 bigint, n2 bigint, has_ties boolean, u1 double, z double, mannwhitney_p double"
    out = stats.mapInPandas(add_p, fields)
    # Arrow hands missing numbers over as NaN.
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("u1", "z", "mannwhitney_p")})


def group_comparison(
    df: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    label_col: str = "diagnosis",
    alpha: float = ALPHA,
) -> DataFrame:
    """Group means, highest class and, for two classes, the rank test of every feature."""
    means = group_means(df, features, classes, label_col)
    if len(classes) != 2:
        return means
    tests = mann_whitney(df, features, classes, label_col).select("feature", "mannwhitney_p")
    return means.join(tests, "feature", "left").withColumn(
        "significant", F.coalesce(F.col("mannwhitney_p") < alpha, F.lit(False))
    )


def anova_f(df: DataFrame, features: Sequence[str], label_col: str = "label") -> DataFrame:
    """One-way ANOVA F score of every feature over the classes, from one grouped pass."""
    stats = ["n", "m", "v"]
    aggs = []
    for c in features:
        aggs += [
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")
            ).alias(c)
        ]
    per = df.groupBy(label_col).agg(*aggs)
    long = per.unpivot([label_col], list(features), "feature", "s").select(
        "feature", *[F.col(f"s.{x}").alias(x) for x in stats]
    ).where("n > 0")
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n_all"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("groups"),
    )
    grand = F.col("s1") / F.col("n_all")
    between = F.aggregate(
        "groups", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - grand) * (g["m"] - grand)
    )
    top = between / F.nullif(F.col("k") - 1, F.lit(0))
    bottom = F.col("within") / F.nullif(F.col("n_all") - F.col("k"), F.lit(0))
    return sums.select("feature", (top / F.nullif(bottom, F.lit(0.0))).alias("f_score"))


def top_features(scores: DataFrame, k: int, score: str = "f_score") -> DataFrame:
    return scores.orderBy(F.col(score).desc_nulls_last(), "feature").limit(k)


# --- batch markers ----------------------------------------------------------------------------


def rank_auc(r1: Column, n1: Column, n: Column) -> Column:
    """AUC from the rank sum of the positive rows; missing when one side is empty."""
    n1, n = n1.cast("double"), n.cast("double")
    return (r1 - n1 * (n1 + 1) / 2) / F.nullif(n1 * (n - n1), F.lit(0.0))


def symmetric(auc: Column) -> Column:
    return F.greatest(auc, 1 - auc)


def feature_auc(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """Symmetric rank AUC of every feature for one binary grouping of the rows."""
    long = to_long(df.withColumn("_g", F.coalesce(positive, F.lit(False))), ["_g"], features)
    ties = tie_groups(long, ["feature"], "value", {"n1": F.col("_g")})
    ranked = rank_groups(ties, ["feature"], "value", long=long, n_groups=len(features))
    sums = ranked.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("n1") * F.col("avg_rank")).alias("r1")
    )
    return sums.select(
        "feature", symmetric(rank_auc(F.col("r1"), F.col("n1"), F.col("n"))).alias("auc")
    )


def batch_markers(
    df: DataFrame,
    features: Sequence[str],
    positive: str,
    study_col: str = "study",
    label_col: str = "diagnosis",
) -> DataFrame:
    """Which features identify the study better than the class.

    Values are ranked once. The study AUC is the largest over all studies of "this study against the
    rest"; it and the class AUC are symmetric, so 0.5 says nothing and 1 separates perfectly. A table
    with fewer than two studies yields no rows; a feature seen in one study only has no study AUC.
    """
    long = to_long(df, [study_col, label_col], features)
    ties = tie_groups(long, ["feature", study_col], "value", {"pos": F.col(label_col) == positive})
    ranked = rank_groups(ties, ["feature"], "value", long=long, n_groups=len(features), peers=True)
    by_study = (
        ranked.groupBy("feature", F.col(study_col).alias("study"))
        .agg(
            F.sum("n").alias("n_s"),
            F.sum("pos").alias("pos_s"),
            F.sum(F.col("n") * F.col("avg_rank")).alias("r_s"),
            F.sum(F.col("pos") * F.col("avg_rank")).alias("rpos_s"),
        )
    )
    # What is left has one row per feature and study.
    n = F.sum("n_s").over(Window.partitionBy("feature"))
    per_feature = (
        by_study.withColumn("a", symmetric(rank_auc(F.col("r_s"), F.col("n_s"), n)))
        .groupBy("feature")
        .agg(
            F.max("a").alias("auc_predicts_study"),
            F.sum("n_s").alias("n"),
            F.sum("pos_s").alias("pos"),
            F.sum("rpos_s").alias("r1"),
            F.min("study").alias("_first"),
            F.max("study").alias("_last"),
        )
    )
    everyone = Window.partitionBy(F.lit(1))
    study, diagnosis = F.col("auc_predicts_study"), F.col("auc_predicts_diagnosis")
    risk = F.when(study > SEVERE_AUC, "SEVERE").when(study > HIGH_AUC, "high").otherwise("")
    return (
        per_feature.withColumn("_several", F.min("_first").over(everyone) < F.max("_last").over(everyone))
        .where("_several")
        .select(
            "feature",
            "auc_predicts_study",
            symmetric(rank_auc(F.col("r1"), F.col("pos"), F.col("n"))).alias("auc_predicts_diagnosis"),
        )
        .withColumn("batch_dominated", F.coalesce(study > diagnosis, F.lit(False)))
        .withColumn("risk", risk)
        .orderBy(F.col("auc_predicts_study").desc_nulls_last(), "feature")
    )


def batch_summary(markers: DataFrame) -> DataFrame:
    """Counts of study-dominated features and the names of the severe ones."""
    return markers.agg(
        F.count_if("batch_dominated").alias("n_study_dominated"),
        F.count(F.lit(1)).alias("n_features"),
        F.array_sort(F.collect_list(F.when(F.col("risk") == "SEVERE", F.col("feature")))).alias("severe"),
    )
