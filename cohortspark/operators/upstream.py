"""Work on count tables before they become sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import session
from cohortspark.operators.draws import draw_from_counts
from cohortspark.operators.ranks import percentiles
from cohortspark.session import sized


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise when a lookup table holds a key more than once."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"lookup key {key!r} is not unique: {twice[0][key]!r}")


def patch_attribute(
    samples: DataFrame, lookup: DataFrame, column: str, key: str = "sample_id", lookup_key: str | None = None
) -> DataFrame:
    """Replace ``column`` by the looked-up value where there is one; the lookup must be unique."""
    lookup_key = lookup_key or key
    if column not in lookup.columns:
        return samples
    assert_unique(lookup, lookup_key)
    new = lookup.select(F.col(lookup_key).alias(key), F.col(column).alias("_new"))
    return (
        samples.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*samples.columns)
    )


def attach_labels(
    samples: DataFrame,
    labels: DataFrame,
    key: str = "sample_id",
    label_key: str = "run_accession",
    group_col: str = "group",
    out: str = "diagnosis",
    unknown: str = "unknown",
) -> DataFrame:
    """Class label of each run from the side table, ``unknown`` where it has none."""
    assert_unique(labels, label_key)
    found = labels.select(F.col(label_key).alias(key), F.col(group_col).alias(out))
    return samples.join(found, key, "left").withColumn(out, F.coalesce(out, F.lit(unknown)))


def relative_abundance(
    counts: DataFrame, sample: str = "sample_id", reads: str = "reads", taxon: str = "taxon"
) -> DataFrame:
    """Add ``share``: percent of the reads of the sample.

    The rows of a sample are summed where they lie, without a join. Samples with very many rows are counted first and
    get their totals by broadcast, so they stay spread over tasks.
    """
    totals = counts.groupBy(sample).agg(F.sum(reads).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    hot = totals.where(F.col("_rows") > session.HOT_ROWS).select(F.col(sample).alias("_hot"), "_total").persist()
    n_hot = hot.count()
    same = F.col(sample).eqNullSafe(F.col("_hot"))
    rest = counts.join(sized(hot, n_hot), same, "left_anti") if n_hot else counts
    out = rest.withColumn("_total", F.sum(reads).over(Window.partitionBy(sample)))
    if n_hot:
        out = out.unionByName(counts.join(sized(hot, n_hot), same).drop("_hot"))
    return out.withColumn("share", F.lit(100.0) * F.col(reads) / F.nullif("_total", F.lit(0))).drop("_total")


def pivot_taxa(
    counts: DataFrame, taxa: Sequence[str], sample: str = "sample_id", taxon: str = "taxon", value: str = "reads"
) -> DataFrame:
    """One row per sample with a fixed column per taxon; an absent taxon counts 0."""
    wide = counts.groupBy(sample).pivot(taxon, list(taxa)).agg(F.sum(value))
    return wide.na.fill(0, list(taxa))


def group_taxa(
    counts: DataFrame, mapping: DataFrame, sample: str = "sample_id", taxon: str = "taxon", reads: str = "reads"
) -> DataFrame:
    """Sum several taxon names into the column the mapping (taxon, column) gives; others are left out."""
    return (
        counts.join(sized(mapping), taxon)
        .groupBy(sample, F.col("column").alias(taxon))
        .agg(F.sum(reads).alias(reads))
    )


def assemble_samples(
    phylum: DataFrame,
    genus: DataFrame,
    diversity: DataFrame,
    metadata: DataFrame,
    phyla: Sequence[str],
    genera: Sequence[str],
    key: str = "sample_id",
) -> DataFrame:
    """Wide sample table from two long count tables, the diversity table and the metadata."""
    high = pivot_taxa(relative_abundance(phylum), phyla, key, value="share")
    low = pivot_taxa(relative_abundance(genus), genera, key, value="share")
    return metadata.join(high, key, "left").join(low, key, "left").join(diversity, key, "left")


def shannon(
    counts: DataFrame, sample: str = "sample_id", reads: str = "reads", base: float = 2.0
) -> DataFrame:
    """Shannon diversity per sample, in one aggregate: H = log(N) - sum(n log n) / N."""
    n = F.col(reads).cast("double")
    present = counts.where(F.col(reads) > 0)
    h = F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)
    return present.groupBy(sample).agg((h / F.ln(F.lit(float(base)))).alias("shannon"))


def rarefy(
    counts: DataFrame,
    depth: int,
    seed: int = 42,
    sample: str = "sample_id",
    taxon: str = "taxon",
    reads: str = "reads",
) -> DataFrame:
    """Draw ``depth`` reads of every sample without replacement; shallower samples are left out.

    Counts are split, never expanded: a taxon costs one row however many reads it has.
    """
    return draw_from_counts(counts, depth, seed, sample, taxon, reads)


def rarefied_shannon(
    counts: DataFrame, depth: int, seed: int = 42, sample: str = "sample_id", base: float = 2.0
) -> DataFrame:
    """Diversity at a common depth; missing for the samples below that depth."""
    return (
        counts.select(sample)
        .distinct()
        .join(shannon(rarefy(counts, depth, seed, sample), sample, base=base), sample, "left")
    )


def label_from_identifier(
    df: DataFrame, mapping: DataFrame, pattern: str, id_col: str, out: str = "diagnosis", unknown: str = "unknown"
) -> DataFrame:
    """Class from the first group of ``pattern`` in an identifier, through a (prefix, label) mapping."""
    prefixed = df.withColumn("prefix", F.regexp_extract(id_col, pattern, 1))
    return (
        prefixed.join(sized(mapping.withColumnRenamed("label", "_label")), "prefix", "left")
        .withColumn(out, F.coalesce("_label", F.lit(unknown)))
        .drop("prefix", "_label")
    )


def study_presence(long: DataFrame, study: str = "study", value: str = "value") -> DataFrame:
    """Per feature and study: rows with a value, share above zero and median of the values."""
    v = F.col(value)
    counts = long.groupBy("feature", study).agg(
        F.count(v).alias("n"),
        (F.count_if(v > 0) / F.nullif(F.count(v), F.lit(0))).alias("present_share"),
    )
    return counts.join(percentiles(long, ["feature", study], value, {"median": 0.5}), ["feature", study], "left")


def median_spread(presence: DataFrame) -> DataFrame:
    """Ratio of the largest to the smallest study median of each feature."""
    low = F.nullif(F.min("median"), F.lit(0.0))
    return presence.groupBy("feature").agg((F.max("median") / low).alias("median_ratio"))
