"""Query of the filter audit and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.filter_audit import audit, failing_repeat, mask_of
from cohortspark.llm.registry import register, table

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"

_AHEAD = " + ".join(f"CASE WHEN p > instr(filter_order, '{c}') THEN {1 << k} ELSE 0 END" for k, c in enumerate(FILTERS))
_BIT = "CASE substr(filter_order, p, 1) " + " ".join(f"WHEN '{c}' THEN {1 << k}" for k, c in enumerate(FILTERS)) + " END"
_LETTERS = ", ".join(f"('{c}')" for c in FILTERS)
_APART = " AND ".join(f"f{a}.c <> f{b}.c" for a in range(5) for b in range(a + 1, 5))

SQL = rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
v AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM w),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM v),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
  count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES {_LETTERS}) AS t(c)),
o AS (SELECT f0.c || f1.c || f2.c || f3.c || f4.c AS filter_order FROM f AS f0, f AS f1, f AS f2, f AS f3, f AS f4 WHERE {_APART}),
s AS (SELECT filter_order, p, {_BIT} AS bit, {_AHEAD} AS ahead FROM o, (SELECT unnest(range(1, 6)) AS p)),
r AS (SELECT part, filter_order, CAST(p AS INTEGER) AS step, bit,
  CAST(sum(CASE WHEN mask & (bit | ahead) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & ahead = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & ahead > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & ahead = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & ahead = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def failures(text: Column) -> list[Column]:
    """Conditions of the filters A to D; each word list is split once."""
    words = F.array_remove(F.split(text, BLANK), "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        counted["n"] < 100,
        F.lit(100).cast("long") * counted["k"] < F.lit(80).cast("long") * counted["n"],
        F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (part, mask, n, good, toxic) of the failure masks; a label joins rows by id, whatever else it holds."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        mask_of(failures(text)).alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    flags = [F.max((F.col(c) == 1).cast("long")).alias(f) for c, f in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(*flags)
    # Rows without an id match nothing; a second key spreads them.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = slim.withColumn("_spread", spread).join(
        known.withColumn("_none", F.lit(0).cast("long")),
        (F.col("doc_id") == F.col("_of")) & (F.col("_spread") == F.col("_none")),
        "left",
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = joined.select("digest", "doc_id", "part", "mask", zero("good"), zero("toxic"))
    return failing_repeat(rows, FILTERS.index("E"), ["good", "toxic"])


@register("op12_filter_audit", SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(counts, FILTERS, ["good", "toxic"])
