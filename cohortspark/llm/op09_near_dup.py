"""Query of near-duplicate groups and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.near_dup import near_duplicates
from cohortspark.llm.registry import register, table

# Components of links among the documents of a table or an earlier stage; asks for (doc_id, text).
COMPONENTS_SQL = r"""{p}w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
{p}sh AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS s
  FROM {p}w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
{p}n AS (SELECT doc_id, count(*) AS n FROM {p}sh GROUP BY doc_id),
{p}links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM {p}sh AS a JOIN {p}sh AS b USING (s)
  JOIN {p}n AS na ON na.doc_id = a.doc_id JOIN {p}n AS nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
{p}reach AS (SELECT doc_id AS node, doc_id AS root FROM {p}w
  UNION SELECT b, root FROM {p}reach JOIN {p}links ON a = node),
{p}comp AS (SELECT node AS doc_id, min(root) AS component_id FROM {p}reach GROUP BY node)"""


@register(
    "op9_near_dup",
    f"""WITH RECURSIVE {COMPONENTS_SQL.format(p='', docs='documents')}
SELECT comp.doc_id, coalesce(n, 0) AS n_shingles, component_id, comp.doc_id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id""",
)
def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
