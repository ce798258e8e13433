"""ROC and precision-recall points, AUC and decision thresholds from a table of scores.

Scores are first combined to one row per distinct score, then running totals from the highest score
down give the true and false positives of every cut. ``keys`` separates curves (models, classes); it
must be a small set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ranks import running_totals

# The sensitivity floor and the cut used when no other is found.
TARGET_SENSITIVITY = 0.85
DEFAULT_CUT = 0.5


def cut_table(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Per distinct score: rows of the score, rows at or above it, and the class totals."""
    keys = list(keys)
    known = scored.where(F.col(score).isNotNull())
    groups = known.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    running = running_totals(
        groups, keys, score, ["pos", "neg"], descending=True, totals=True
    )
    return running.withColumns(
        {
            "tp": F.col("before_pos") + F.col("pos"),
            "fp": F.col("before_neg") + F.col("neg"),
            "n_pos": F.col("total_pos"),
            "n_neg": F.col("total_neg"),
        }
    ).drop("total_pos", "total_neg")


def _share(top, bottom):
    return top / F.nullif(bottom, F.lit(0))


def roc_points(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """True and false positive rate of every cut; the curve also starts at (0, 0) above all scores."""
    cuts = cut_table(scored, score, label, keys)
    return cuts.select(
        *keys,
        F.col(score).alias("threshold"),
        _share(F.col("fp"), F.col("n_neg")).alias("fpr"),
        _share(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def pr_points(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    cuts = cut_table(scored, score, label, keys)
    return cuts.select(
        *keys,
        F.col(score).alias("threshold"),
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def auc(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve, exact under ties; missing when a class has no rows."""
    cuts = cut_table(scored, score, label, keys)
    area = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2))
    size = F.max("n_pos").cast("double") * F.max("n_neg")
    return cuts.groupBy(*keys).agg((area / F.nullif(size, F.lit(0.0))).alias("auc"))


def ovr_auc(
    scored: DataFrame, classes: Sequence[str], probability: str = "probability", label: str = "label"
) -> DataFrame:
    """One-vs-rest AUC per class from an array of class scores; classes without rows are left out."""
    pairs = scored.select(
        F.col(label).alias("_y"), F.posexplode(F.col(probability)).alias("_class", "score")
    ).select("_class", F.col("score"), (F.col("_y") == F.col("_class")).cast("int").alias("_is"))
    areas = auc(pairs, "score", "_is", ["_class"]).where(F.col("auc").isNotNull())
    names = F.array(*[F.lit(c) for c in classes])
    return areas.select(F.try_element_at(names, F.col("_class") + 1).alias("class"), "auc")


def apply_threshold(scored: DataFrame, cut: float, score: str = "score", out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, (F.col(score) >= F.lit(float(cut))).cast("int"))


def _first_per_key(df: DataFrame, keys: Sequence[str], quality: str, highest_cut: bool) -> DataFrame:
    """Cut with the best quality; ties go to the highest or the lowest cut. A plain maximum per key."""
    tie = F.col("threshold") if highest_cut else -F.col("threshold")
    best = df.groupBy(*keys).agg(
        F.max(F.struct(F.col(quality).alias("q"), tie.alias("t"), F.col("threshold").alias("threshold"))).alias("b")
    )
    return best.select(*keys, F.col("b.q").alias("quality"), F.col("b.threshold").alias("threshold"))


def _or_default(found: DataFrame) -> DataFrame:
    return found.withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_CUT)))


def threshold_f1(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Cut with the largest F1 of the positive class; ties -> lowest cut; no scores -> 0.5."""
    points = pr_points(scored, score, label, keys)
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r + F.lit(1e-12))).otherwise(F.lit(0.0))
    rounded = points.withColumn("q", F.round(f1, 12))
    return _or_default(_first_per_key(rounded, keys, "q", highest_cut=False))


def threshold_f2(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Cut with the largest F2 (recall counts double); ties -> lowest cut."""
    cuts = cut_table(scored, score, label, keys).withColumnRenamed(score, "threshold")
    bottom = 5 * F.col("tp") + 4 * (F.col("n_pos") - F.col("tp")) + F.col("fp")
    f2 = F.coalesce(5 * F.col("tp") / F.nullif(bottom, F.lit(0)), F.lit(0.0))
    return _or_default(_first_per_key(cuts.withColumn("q", F.round(f2, 12)), keys, "q", highest_cut=False))


def threshold_youden(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Cut with the largest tpr - fpr; ties -> highest cut; 0.5 when no cut beats predicting nothing."""
    points = roc_points(scored, score, label, keys).withColumn("q", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = _first_per_key(points, keys, "q", highest_cut=True)
    # The curve starts above all scores with tpr = fpr = 0, so a positive gain is needed.
    return _or_default(best.withColumn("threshold", F.when(F.col("quality") > 0, F.col("threshold"))))


def threshold_sensitivity(
    scored: DataFrame,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = (),
    target: float = TARGET_SENSITIVITY,
) -> DataFrame:
    """Highest cut whose true positive rate reaches the target; 0.5 when none does."""
    points = roc_points(scored, score, label, keys)
    reach = F.when(F.col("tpr") >= target, F.col("threshold"))
    return _or_default(points.groupBy(*keys).agg(F.max(reach).alias("threshold")))


POLICIES = {
    "f1": threshold_f1,
    "f2": threshold_f2,
    "youden": threshold_youden,
    "sensitivity": threshold_sensitivity,
}


def choose_threshold(scored: DataFrame, policy: str, score: str = "score", label: str = "label") -> float:
    """Value of a threshold policy on out-of-fold scores; ``fixed`` is 0.5."""
    if policy == "fixed":
        return DEFAULT_CUT
    return float(POLICIES[policy](scored, score, label).first()["threshold"])
