"""Query of periodic run detection and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.periodic import find_runs
from cohortspark.llm.registry import register, table

BLANK = r"[\x20\x09-\x0D]+"

# CRC-32 of a decimal number, bit by bit: the reversed polynomial is shifted in eight times per digit.
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda crc, digit: list_reduce([xor(crc, digit), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
# A run has at least six matches in a row (word i equals word i + p), so it is found where six words recur p words later.
SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, crc32_of AS h FROM
  (SELECT *, {_CRC} AS crc32_of FROM documents)),
a AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM a),
c AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
  list_slice(w, 1, a) || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w FROM c),
six AS (SELECT doc_id, i, hash(list_slice(w, i + 1, i + 6)) AS s FROM t, LATERAL (SELECT unnest(range(0, n - 5)) AS i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM six AS x JOIN six AS y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
part AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pairs),
stretch AS (SELECT doc_id, p, min(i) AS start, count(*) + 5 + p AS length FROM part GROUP BY doc_id, p, k),
long AS (SELECT * FROM stretch WHERE length >= greatest(12, 2 * p)),
runs AS (SELECT * FROM long AS x WHERE NOT EXISTS (SELECT 1 FROM long AS y WHERE y.doc_id = x.doc_id AND y.p < x.p
  AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'p': p}}, (-length, start, p)) AS r,
  string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM runs),
left_over AS (SELECT t.doc_id, string_agg(t.w[u.i + 1], ' ' ORDER BY u.i) AS kept
  FROM t, LATERAL (SELECT unnest(range(0, n)) AS i) AS u WHERE NOT EXISTS
  (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id AND gone.i = u.i) GROUP BY t.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.p AS period,
  1000 * r.length // r.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN left_over ON left_over.doc_id = t.doc_id"""


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with its planted period; texts without an id stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        kept = F.slice(words, F.lit(1), a.cast("int"))
        period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        rest = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(kept, rest), " ")).otherwise("")

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")
    # The list of one word list names it, so that the text is split once.
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from documents with runs and collapsed."""
    order = F.array_sort(
        F.transform("runs", lambda r: F.struct(-r["length"].alias("l"), r["start"], r["period"], r["length"].alias("n")))
    )
    best = F.get(order, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["n"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["n"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@register("op11_runs", SQL)
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    return digests(find_runs(docs))
