"""Scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metadata columns of a sample table and of a sequencing run report.
METADATA_COLS = ("sample_id", "study", "diagnosis", "sample_type", "country")
RUN_REPORT_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("run_accession", "fastq_ftp", "fastq_bytes", "library_strategy", "sample_title")
    ]
)


def sample_schema(features: Sequence[str], metadata: Sequence[str] = METADATA_COLS) -> T.StructType:
    """Text metadata and double features. Inference would turn an empty feature column into text."""
    fields = [T.StructField(c, T.StringType()) for c in metadata]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in features])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_samples(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Scan of header CSV files; an absent path is an error. Columns are matched by name, not by place.

    The header decides the order of the columns, so the scan reads the declared ones as text by their
    own names and then casts them; a declared column a study lacks is missing there. A path may be a
    folder or a glob of part files that share one header: give one path per study layout, not per file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return reduce(DataFrame.unionByName, [read_layout(spark, [p], schema) for p in paths])


def read_layout(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """One scan of files that share a header. A file with another header is an error, not a shift of columns."""
    names = spark.read.option("header", True).csv(paths[0]).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(paths)
    have = set(names)
    return raw.select(
        *[(_typed(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    )


def _typed(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return c
    number = c.try_cast(field.dataType)
    # Text such as "nan" stands for a missing number.
    return F.when(~F.isnan(number), number) if isinstance(field.dataType, T.DoubleType) else number


def read_studies(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Union of the study files that exist, and the table of paths that were skipped.

    Raises when none of the paths exists.
    """
    present = [p for p in paths if _exists(spark, p)]
    skipped = [(p,) for p in paths if p not in present]
    if not present:
        raise FileNotFoundError(f"none of the study files exists: {list(paths)}")
    return read_samples(spark, present, schema), spark.createDataFrame(skipped, "path string")


def read_side_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV of text columns, such as sample labels keyed by run accession."""
    return read_samples(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_run_report(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated run report whose file columns hold ``;``-separated lists."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.select(*[F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name) for f in RUN_REPORT_SCHEMA])


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated run table with quoted lists and backslash escapes inside a field."""
    return spark.read.option("header", True).option("quote", '"').option("escape", "\\").csv(path)


def explode_run_files(runs: DataFrame) -> DataFrame:
    """One row per (run, file) from the paired lists of file names and sizes."""
    pairs = F.arrays_zip(
        F.split("fastq_ftp", ";").alias("file"), F.split("fastq_bytes", ";").alias("bytes")
    )
    listed = runs.select("run_accession", F.posexplode(pairs).alias("file_no", "f"))
    return listed.select(
        "run_accession",
        (F.col("file_no") + 1).alias("file_no"),
        F.col("f.file").alias("file"),
        F.col("f.bytes").try_cast("bigint").alias("bytes"),
    )
