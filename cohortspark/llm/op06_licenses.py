"""Query of the license scan and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.licenses import BASE, TEMPLATES, scan, words_of
from cohortspark.llm.registry import register, table, words_sql

_TEMPLATE_ROWS = ", ".join(f"({t}, '{x.label}', {i}, '{w}')" for t, x in enumerate(TEMPLATES) for i, w in enumerate(x.words()))
_KEY_ROWS = ", ".join(
    f"({t}, {n}, {o + i}, '{w}')" for t, x in enumerate(TEMPLATES) for n, (o, k) in enumerate(x.key_places()) for i, w in enumerate(k)
)
_BASE_ROWS = ", ".join(f"({words_of(p)!r}, '{label}')" for p, label in BASE.items())


@register(
    "op6_licenses",
    f"""WITH tw(t, label, o, w) AS (VALUES {_TEMPLATE_ROWS}), kw(t, n, o, w) AS (VALUES {_KEY_ROWS}),
bp(p, label) AS (VALUES {_BASE_ROWS}),
d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
x AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, w[i] AS w FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
post AS (SELECT t, o, w FROM kw QUALIFY row_number() OVER (PARTITION BY t ORDER BY o) = 1),
agreed AS (SELECT doc_id, t, i - o AS s FROM x JOIN post USING (w)),
keyed AS (SELECT a.doc_id, a.t, a.s FROM agreed AS a JOIN kw ON kw.t = a.t
  LEFT JOIN x ON x.doc_id = a.doc_id AND x.i = a.s + kw.o AND x.w = kw.w
  GROUP BY a.doc_id, a.t, a.s HAVING count(*) = count(x.i)),
shared AS (SELECT k.doc_id, k.t, k.s, any_value(tw.label) AS label, CAST(count(x.i) AS DOUBLE) / count(*) AS share
  FROM keyed AS k JOIN tw ON tw.t = k.t LEFT JOIN x ON x.doc_id = k.doc_id AND x.i = k.s + tw.o AND x.w = tw.w
  GROUP BY k.doc_id, k.t, k.s),
base AS (SELECT doc_id, label, i - 1 AS start FROM d, bp, LATERAL (SELECT unnest(range(1, len(w) - len(p) + 2)) AS i)
  WHERE list_slice(w, i, i + len(p) - 1) = p),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
m AS (SELECT doc_id, max(share) AS share FROM shared GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM shared) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CASE WHEN n_base > 0 THEN 1e0 ELSE round(coalesce(share, 0e0), 6) END AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id""",
)
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is 1 with a base phrase, else the best share of a template's words that stand in their places."""
    rows = scan(table(spark, sf_dir, "documents"))
    base_labels = F.transform("base", lambda b: b["label"])
    all_labels = F.concat(base_labels, F.transform("found", lambda f: f["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("base", lambda b: b["start"])
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(all_labels).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.round(best, 6)).alias("score"),
    )
