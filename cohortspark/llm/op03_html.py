"""Query of main-text extraction. A scan over markup has no SQL; tests compare with pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.html_text import extract, fit
from cohortspark.llm.registry import register, table


@register("op3_html")
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
