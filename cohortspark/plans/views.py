"""Sample tables derived from the driver tables, each as a Spark plan and as the same SQL text."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import shuffle_partitions

CLASSES = ("Control", "Case")
TEXT_FEATURES = ("e", "n", "t", "a", "z")
FULL_FEATURES = ("e", "n", "t", "z")
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
VECTOR_CLASSES = tuple(f"c{i}" for i in range(10))
TAXA = ("the", "of", "and", "de", "la")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter_share(letter: str, text: str = "text"):
    n = F.length(text)
    return F.lit(100.0) * (n - F.length(F.replace(F.col(text), F.lit(letter), F.lit("")))) / n


def share_sql(letter: str, text: str = "text") -> str:
    return f"100e0 * (length({text}) - length(replace({text}, '{letter}', ''))) / length({text})"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as samples: the source is the study, letter shares are the features.

    A compositional table like relative abundances; ``a`` is missing on flagged documents.
    """
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    labels = table(spark, sf_dir, "labels")
    shares = {c: letter_share(c) for c in FULL_FEATURES}
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("study"),
        F.when(F.col("quality") == 1, "Case").otherwise("Control").alias("diagnosis"),
        F.col("lang").alias("sample_type"),
        F.when(F.col("quality") == 1, 1).otherwise(0).alias("label"),
        *[
            (F.when(F.col("toxic") != 1, letter_share("a")) if c == "a" else shares[c]).alias(c)
            for c in TEXT_FEATURES
        ],
    )


SAMPLES_SQL = f"""samples AS (
  SELECT doc_id AS sample_id, source AS study,
         CASE WHEN quality = 1 THEN 'Case' ELSE 'Control' END AS diagnosis, lang AS sample_type,
         CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label,
         {share_sql('e')} AS e, {share_sql('n')} AS n, {share_sql('t')} AS t,
         CASE WHEN toxic <> 1 THEN {share_sql('a')} END AS a, {share_sql('z')} AS z
  FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0)"""

LONG_SQL = f"""{SAMPLES_SQL},
long AS (
  SELECT sample_id, study, diagnosis, label, feature, value
  FROM samples UNPIVOT INCLUDE NULLS (value FOR feature IN (e, n, t, a, z))),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
            + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS r
  FROM long WHERE value IS NOT NULL)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples: class = returned or not, study = line status."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.col("l_linestatus").alias("study"),
        F.when(F.col("l_returnflag") == "R", "Case").otherwise("Control").alias("diagnosis"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        *LINE_FEATURES,
    )


LINES_SQL = """lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, l_linestatus AS study,
         CASE WHEN l_returnflag = 'R' THEN 'Case' ELSE 'Control' END AS diagnosis,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples of ten classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        "label",
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


def vector_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with one column per coordinate."""
    df = table(spark, sf_dir, "embeddings")
    size = F.size("embedding")
    widths = df.agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    if widths["least"] != widths["most"]:
        raise ValueError(f"vectors have {widths['least']} to {widths['most']} coordinates")
    width = widths["most"] or 0
    names = [f"v{i}" for i in range(width)]
    return df.select(
        F.col("vec_id").alias("sample_id"),
        "label",
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)],
    ), names


# Texts are dealt by sample in parts of at most about PART_BYTES, of less while there are fewer parts than shuffle partitions;
# a sample with more text than HOT_TEXT_BYTES is dealt by token.
PART_BYTES = 4 << 20
LEAST_BYTES = 128 << 10
HOT_TEXT_BYTES = 64 << 20


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long count table: blank-separated tokens of the whole texts are taxa, occurrences are reads.

    Whole texts are shuffled, which is less than their tokens, and the rows of a sample lie in one partition, so what
    is grouped by sample afterwards moves nothing.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    sizes = docs.groupBy("sample_id").agg(F.sum(F.octet_length("text")).alias("b"))
    total, most = sizes.agg(F.sum("b"), F.max("b")).first()
    total = total or 0
    parts = max(total // PART_BYTES, min(shuffle_partitions(spark), total // LEAST_BYTES)) + 1
    if (most or 0) <= HOT_TEXT_BYTES:
        return _counted(docs.repartition(parts, "sample_id"))
    # At most total / HOT_TEXT_BYTES samples.
    hot = F.broadcast(sizes.where(F.col("b") > HOT_TEXT_BYTES).select(F.col("sample_id").alias("_hot")))
    same = F.col("sample_id").eqNullSafe(F.col("_hot"))
    rest = docs.join(hot, same, "left_anti").repartition(parts, "sample_id")
    return _counted(rest).unionByName(_counted(docs.join(hot, same, "left_semi")))


def _counted(docs: DataFrame) -> DataFrame:
    tokens = docs.select("sample_id", F.explode(F.split("text", " ")).alias("taxon"))
    return tokens.where("taxon <> ''").groupBy("sample_id", "taxon").agg(F.count(F.lit(1)).alias("reads"))


COUNTS_SQL = """counts AS (
  SELECT sample_id, taxon, count(*) AS reads FROM (
    SELECT doc_id AS sample_id, unnest(string_split(text, ' ')) AS taxon FROM documents)
  WHERE taxon <> '' GROUP BY 1, 2)"""

SPLIT_SQL = f"""{SAMPLES_SQL},
sizes AS (
  SELECT label, n_class, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= test - sum(base) OVER ()
                                     THEN 1 ELSE 0 END AS n_test
  FROM (SELECT label, n_class, test, floor(test * n_class / total) AS base,
               round(test * n_class / total - floor(test * n_class / total), 9) AS rest
        FROM (SELECT label, count(*) AS n_class, sum(count(*)) OVER () * 1e0 AS total,
                     ceil(sum(count(*)) OVER () * 0.2e0) AS test
              FROM samples GROUP BY label))),
split AS (
  SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', sample_id)), sample_id)
              <= n_test AS is_test
  FROM samples s JOIN sizes USING (label)),
folded AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', sample_id)), sample_id) - 1)
            % 5 AS fold
  FROM samples)"""
