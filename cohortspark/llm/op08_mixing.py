"""Query of the source mix and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.mixing import taken
from cohortspark.llm.registry import register, table


@register(
    "op8_mixing",
    r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n,
  (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, CAST(sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM r),
f AS (SELECT min(k) AS k FROM c WHERE w * rest <= 3 * n * open),
t AS (SELECT c.source, c.n, CASE WHEN c.k < f.k THEN CAST(3 * c.n AS DOUBLE)
  ELSE CAST(c.w * x.rest AS DOUBLE) / CAST(x.open AS DOUBLE) END AS target FROM c, f, c AS x WHERE x.k = f.k),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS q FROM t),
p AS (SELECT d.doc_id, d.source, d.size, q.n AS source_size, q.target, CASE WHEN q.n > 0 THEN q.q // q.n ELSE 0 END AS passes,
  CASE WHEN q.n > 0 THEN q.q % q.n ELSE 0 END AS last,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source),
j AS (SELECT *, CAST(before AS BIGINT) // greatest(1, CAST((SELECT sum(size) FROM d) AS BIGINT) // 32768) AS j FROM p),
b AS (SELECT source, j, min(before) AS first, sum(size) AS n FROM j WHERE size > 0 GROUP BY source, j),
o AS (SELECT source, j, first, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('mix|' || coalesce(source, '') || '|' || CAST(j AS VARCHAR))
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b)
SELECT j.doc_id, j.size, j.source_size, j.target,
CAST(j.size * (j.passes + CASE WHEN j.size > 0 AND 2 * (j.last - (o.ahead + j.before - o.first)) >= j.size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j LEFT JOIN o ON o.source IS NOT DISTINCT FROM j.source AND o.j = j.j""".replace(' COLLATE "C"', ""),
)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
