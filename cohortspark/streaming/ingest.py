"""Arriving study files to one table of samples, each sample once.

A file source remembers the files it has read, so a rerun picks up the new ones only. Every micro-batch
is written to its own partition with dynamic overwrite: a batch that is repeated after a failure
replaces what it wrote before. A row without a key is no copy of another one: all of them are kept.

CSV files are matched by column name. The stream only tells which files arrived; they are read again by layout, that is
together with the other files of the batch that have the same header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.readers import read_layout


# Names of so many files at most are held by the driver at a time.
FILES_PER_BATCH = 1000


def _by_name(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Samples of the files the lines come from, one scan for each header."""
    # The first line of a file is the first row of the split that begins at 0.
    heads = lines.where(F.col("at") == 0).groupBy("file").agg(F.first("value").alias("header"))
    layouts = heads.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    spark = lines.sparkSession
    parts = [read_layout(spark, sorted(r["files"]), schema) for r in layouts]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _first_copy(df: DataFrame, key: str) -> DataFrame:
    """One row per key, chosen by content, and all rows without a key; copies of one key are combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r"))
    return known.select(key, "_r.*").select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def ingest_studies(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    schema: T.StructType,
    *,
    fmt: str = "csv",
    key: str = "sample_id",
    study: str = "study",
    glob: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> None:
    """Append the samples of all files that arrived since the last call, then stop."""
    by_name = fmt == "csv"
    reader = spark.readStream.format("text") if by_name else spark.readStream.format(fmt).schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])

    def append(batch: DataFrame, batch_id: int) -> None:
        if by_name:
            batch = _by_name(batch, schema)
        fresh = _first_copy(batch, key)
        if _has_files(spark, table):
            # A repeated batch must not see its own earlier output.
            known = spark.read.schema(stored).parquet(table).where((F.col("batch_id") != batch_id) & F.col(key).isNotNull())
            fresh = fresh.join(known.select(key), key, "left_anti")
        (
            fresh.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", study)
            .parquet(table)
        )

    arriving = reader.load(source)
    if by_name:
        arriving = arriving.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    query = (
        arriving
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_ingested(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All ingested samples."""
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(stored).parquet(table).select(*schema.names)
