"""Query of the shard layout. Greedy packing has no SQL; tests compare with a plain packer and check the law."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register, table
from cohortspark.llm.sharding import _size, shard_documents


@register("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    carry = [F.col("doc_id"), _size("text").alias("size"), crc]
    rows = shard_documents(table(spark, sf_dir, "documents"), carry=carry)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
