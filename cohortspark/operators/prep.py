"""Label handling, filters, feature columns and reshaping of sample tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions import (
    class_index,
    class_name,
    clip_lower,
    finite_or_zero,
    nan_to_null,
    ratio,
    strip_whitespace,
)
from cohortspark.session import sized

# Metadata that never counts as a feature, body sites accepted as gut, ratio guard.
NON_FEATURE_COLS = ("sample_id", "study", "sample_type", "country", "subject_id", "diagnosis")
EPS = 1e-6


class Ratio(NamedTuple):
    name: str
    numerator: str
    denominator: str


# The ratio features of the published tables.
DEFAULT_RATIOS = (
    Ratio("FB_ratio", "Firmicutes", "Bacteroidetes"),
    Ratio("BL_ratio", "Bacteroides", "Lactobacillus"),
    Ratio("Fae_Bact_ratio", "Faecalibacterium", "Bacteroides"),
    Ratio("BG_Lacto_ratio", "beta_glucuronidase", "Lactobacillus"),
    Ratio("PB_ratio", "Prevotella", "Bacteroides"),
)


def union_studies(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all studies, columns matched by name, absent columns missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def known_labels(df: DataFrame, classes: Sequence[str], label_col: str = "diagnosis") -> DataFrame:
    """Strip the label and keep the rows of the declared classes; a missing label is dropped."""
    return df.withColumn(label_col, strip_whitespace(F.col(label_col))).where(F.col(label_col).isin(*classes))


def encode_label(
    df: DataFrame, classes: Sequence[str], label_col: str = "diagnosis", out: str = "label"
) -> DataFrame:
    """Number the classes in their declared order."""
    return df.withColumn(out, class_index(F.col(label_col), classes).cast("int"))


def decode_label(df: DataFrame, classes: Sequence[str], index_col: str, out: str) -> DataFrame:
    return df.withColumn(out, class_name(F.col(index_col), classes))


def keep_sites(df: DataFrame, sites: Sequence[str], site_col: str = "sample_type") -> DataFrame:
    """Keep accepted body sites (any letter case); a table without the column passes unchanged."""
    if site_col not in df.columns:
        return df
    return df.where(F.lower(F.col(site_col)).isin(*[s.lower() for s in sites]))


def site_counts(df: DataFrame, sites: Sequence[str], site_col: str = "sample_type") -> DataFrame:
    """How many rows ``keep_sites`` keeps and drops, in one aggregate."""
    if site_col not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("kept"), F.lit(0).cast("bigint").alias("dropped"))
    kept = F.coalesce(F.lower(F.col(site_col)).isin(*[s.lower() for s in sites]), F.lit(False))
    return df.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def numeric_features(df: DataFrame, non_features: Sequence[str] = NON_FEATURE_COLS) -> list[str]:
    """Numeric columns that are not metadata, in table order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in non_features
    ]


def missing_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN is a value to Spark; missing numbers are NULL everywhere in this library."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: nan_to_null(F.col(c)) for c in cols if c in floats})


def drop_empty_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that hold no value on any row (one pass over the table)."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] == 0])


def features_of(df: DataFrame, non_features: Sequence[str] = NON_FEATURE_COLS) -> list[str]:
    """Feature columns of a table after columns without any value are left out."""
    return numeric_features(drop_empty_columns(df, numeric_features(df, non_features)), non_features)


def clip_features(df: DataFrame, cols: Sequence[str], floor: float = 0.0) -> DataFrame:
    return df.withColumns({c: clip_lower(F.col(c), floor) for c in cols})


def ratio_features(df: DataFrame, specs: Sequence[Ratio] = DEFAULT_RATIOS, eps: float = EPS) -> DataFrame:
    """Add every ratio whose two inputs exist, in one projection."""
    have = set(df.columns)
    usable = {
        s.name: ratio(F.col(s.numerator), F.col(s.denominator), eps)
        for s in specs
        if s.numerator in have and s.denominator in have
    }
    return df.withColumns(usable) if usable else df


def fill_non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in cols})


def engineer(
    df: DataFrame,
    features: Sequence[str],
    specs: Sequence[Ratio] = DEFAULT_RATIOS,
    eps: float = EPS,
    clip_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Clip below zero, add ratios, turn what is not a finite number into zero.

    ``clip_cols`` limits the clipping, so that standardised columns keep their lower half; the
    default clips every feature.
    """
    clipped = clip_features(df, features if clip_cols is None else clip_cols)
    out = ratio_features(clipped, specs, eps)
    added = [c for c in out.columns if c not in clipped.columns]
    return fill_non_finite(out, [*features, *added])


def to_long(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value"
) -> DataFrame:
    """One row per (row, feature); missing values are kept."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        list(ids), list(features), name, value
    )


def zscore_within(df: DataFrame, cols: Sequence[str], study_col: str = "study") -> DataFrame:
    """Standardise columns within each study with the population deviation.

    A study without spread gives 0 for present values; a missing value stays missing. The statistics
    use every row of the table, so test rows take part when this runs before a split. They are one
    row per study and join back; no study is gathered in one task.
    """
    stats = df.groupBy(study_col).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )

    def scaled(c: str):
        z = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        usable = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
        return F.when(F.col(c).isNull(), F.lit(None)).when(usable, z).otherwise(F.lit(0.0))

    # Rows without a study form a group of their own and stay.
    stats = stats.withColumnRenamed(study_col, "_study")
    return (
        df.join(sized(stats), F.col(study_col).eqNullSafe(F.col("_study")), "left")
        .withColumns({c: scaled(c) for c in cols})
        .select(*df.columns)
    )


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Weight of each class so that all classes count alike: n / (classes * class rows)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: the window runs over the class table, never over samples.
    everyone = Window.partitionBy(F.lit(1))
    k = F.count(F.lit(1)).over(everyone)
    return counts.withColumn("weight", F.sum("n").over(everyone) / (k * F.col("n")))


def add_class_weight(df: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight; one small aggregate, then a column expression."""
    rows = class_weights(df, label_col).collect()
    weights: Mapping = {r[label_col]: r["weight"] for r in rows}
    expr = F.lit(None).cast("double")
    for value, weight in weights.items():
        expr = F.when(F.col(label_col) == value, F.lit(weight)).otherwise(expr)
    return df.withColumn(out, expr)


def complement(df: DataFrame, part: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``part``."""
    return df.join(part.select(key), key, "left_anti")
