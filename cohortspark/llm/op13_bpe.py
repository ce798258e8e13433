"""Query of byte-level encoding. SQL has no tokenizer; tests compare with the tokenizer library and the texts themselves."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.bpe import decode, encode, load
from cohortspark.llm.registry import register, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@register("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = load(public_tokenizers.path(VOCABULARY))
    out = decode(encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
