"""Query of benchmark decontamination and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.decontaminate import find_matches
from cohortspark.llm.registry import register, table, words_sql

HITS_SQL = f"""dw AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
bw AS (SELECT item_id, w FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {words_sql('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i)),
found AS (SELECT doc_id, i, n, item_id FROM (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM dw, (SELECT DISTINCT len(g) AS n FROM win) AS sizes,
  LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)) AS spots JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
  (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY doc_id)"""


@register(
    "op5_decontaminate",
    f"""WITH {HITS_SQL}
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id""",
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
