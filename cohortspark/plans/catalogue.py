"""Every registered query and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.ml import explain, selection, zoo
from cohortspark.ml.selection import Recipe
from cohortspark.ml.stages import FScoreSelector, KNNImputer, PopulationScaler
from cohortspark.operators import curves, evaluate, expect, neighbours, prep, ranks, splits, stats, upstream
from cohortspark.plans.views import (
    CLASSES,
    COUNTS_SQL,
    FULL_FEATURES,
    LINE_FEATURES,
    LINES_SQL,
    LONG_SQL,
    SAMPLES_SQL,
    SPLIT_SQL,
    TAXA,
    TEXT_FEATURES,
    VECTOR_CLASSES,
    letter_share,
    lines,
    samples,
    share_sql,
    table,
    token_counts,
    vector_columns,
    vectors,
)
from cohortspark.session import fresh_path
from cohortspark.sources import explode_run_files
from cohortspark.streaming import ingest_studies, read_ingested

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, the precision both engines are compared at."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rnd(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


# --- union, labels, filters -------------------------------------------------------------------


@register(
    "load_union",
    f"""WITH {SAMPLES_SQL},
pages_study AS (
  SELECT 'p' || page_id AS sample_id, 'pages' AS study,
         CASE WHEN starts_with(url, 'https') THEN ' Case ' ELSE 'unknown' END AS diagnosis,
         {share_sql('e', 'html')} AS e, {share_sql('t', 'html')} AS t
  FROM pages WHERE length(html) > 0),
everything AS (
  SELECT CAST(sample_id AS VARCHAR) AS sample_id, study, diagnosis, e, n, t, a, z FROM samples
  UNION ALL BY NAME SELECT * FROM pages_study)
SELECT sample_id, study, trim(diagnosis) AS diagnosis,
       CASE trim(diagnosis) WHEN 'Control' THEN 0 WHEN 'Case' THEN 1 END AS label,
       {rnd('e', 'e')}, {rnd('n', 'n')}, {rnd('t', 't')}, {rnd('a', 'a')}, {rnd('z', 'z')}
FROM everything WHERE trim(diagnosis) IN ('Control', 'Case')""",
)
def load_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples(spark, sf_dir).select(
        F.col("sample_id").cast("string").alias("sample_id"), "study", "diagnosis", *TEXT_FEATURES
    )
    pages = (
        table(spark, sf_dir, "pages")
        .where(F.length("html") > 0)
        .select(
            F.concat(F.lit("p"), "page_id").alias("sample_id"),
            F.lit("pages").alias("study"),
            F.when(F.startswith("url", F.lit("https")), " Case ").otherwise("unknown").alias("diagnosis"),
            letter_share("e", "html").alias("e"),
            letter_share("t", "html").alias("t"),
        )
    )
    both = prep.known_labels(prep.union_studies([docs, pages]), CLASSES)
    return rounded(prep.encode_label(both, CLASSES))


@register(
    "site_filter",
    f"""WITH {SAMPLES_SQL} SELECT sample_id, sample_type FROM samples WHERE lower(sample_type) IN ('en', 'fr')""",
)
def site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.keep_sites(samples(spark, sf_dir), ["EN", "fr"]).select("sample_id", "sample_type")


@register(
    "site_filter_counts",
    f"""WITH {SAMPLES_SQL}
SELECT count(*) FILTER (lower(sample_type) IN ('en', 'fr')) AS kept,
       count(*) FILTER (lower(sample_type) NOT IN ('en', 'fr')) AS dropped FROM samples""",
)
def site_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.site_counts(samples(spark, sf_dir), ["en", "fr"])


@register(
    "label_decode",
    """SELECT vec_id AS sample_id, label, 'c' || label AS class FROM embeddings""",
)
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    return prep.decode_label(df, VECTOR_CLASSES, "label", "class")


@register(
    "melt_long",
    f"WITH {LONG_SQL} SELECT sample_id, study, diagnosis, feature, {rnd('value', 'value')} FROM long",
)
def melt_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return rounded(prep.to_long(df, ["sample_id", "study", "diagnosis"], TEXT_FEATURES))


@register(
    "complement_rows",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def complement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return prep.complement(docs, table(spark, sf_dir, "labels"), "doc_id")


@register(
    "drop_empty_columns",
    f"WITH {SAMPLES_SQL} SELECT sample_id, {rnd('e', 'e')}, {rnd('a', 'a')} FROM samples",
)
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).select("sample_id", "e", "a", F.lit(None).cast("double").alias("unmeasured"))
    return rounded(prep.drop_empty_columns(df))


# --- counts and profiles ----------------------------------------------------------------------


@register(
    "class_counts",
    f"""WITH {SAMPLES_SQL}, declared(diagnosis, class_index) AS (VALUES ('Control', 0), ('Case', 1), ('Other', 2))
SELECT diagnosis, class_index, count(sample_id) AS n FROM declared LEFT JOIN samples USING (diagnosis) GROUP BY 1, 2""",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_counts(samples(spark, sf_dir), [*CLASSES, "Other"])


@register(
    "present_classes",
    f"""WITH {SAMPLES_SQL}, declared(diagnosis, class_index) AS (VALUES ('Control', 0), ('Case', 1), ('Other', 2))
SELECT diagnosis, class_index FROM declared SEMI JOIN samples USING (diagnosis)""",
)
def present_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.present_classes(samples(spark, sf_dir), [*CLASSES, "Other"])


@register("study_counts", f"WITH {SAMPLES_SQL} SELECT study, count(*) AS n FROM samples GROUP BY study")
def study_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.study_counts(samples(spark, sf_dir))


@register(
    "value_counts",
    """SELECT CASE WHEN quality IS NOT NULL THEN lang END AS sample_type, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known = docs.select(F.when(F.col("quality").isNotNull(), F.col("lang")).alias("sample_type"))
    return stats.value_counts(known, "sample_type")


@register(
    "study_crosstab",
    f"""WITH {SAMPLES_SQL} SELECT study, count(*) FILTER (diagnosis = 'Control') AS "Control",
count(*) FILTER (diagnosis = 'Case') AS "Case" FROM samples GROUP BY study""",
)
def study_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.study_crosstab(samples(spark, sf_dir), CLASSES)


@register(
    "single_class_studies",
    f"""WITH {SAMPLES_SQL} SELECT study, min(diagnosis) AS only_class, count(*) AS n FROM samples
GROUP BY study HAVING count(DISTINCT diagnosis) = 1""",
)
def single_class_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.single_class_studies(samples(spark, sf_dir))


_FLOOR_SQL = """per AS (
  SELECT study, count(*) AS n_in, count(*) FILTER (label = 1) AS p FROM {src} GROUP BY study),
rates AS (
  SELECT study, n_in, p / nullif(sum(p) OVER (), 0) AS p1, (n_in - p) / nullif(sum(n_in - p) OVER (), 0) AS p0,
         sum(n_in) OVER () AS n FROM per),
aucs AS (
  SELECT study, n_in, CASE WHEN n_in < n THEN p1 * (1 - p0) + 0.5e0 * (p1 * p0 + (1 - p1) * (1 - p0)) END AS a FROM rates)
SELECT study, n_in, round(greatest(a, 1 - a), 6) + 0e0 AS study_auc FROM aucs"""


@register("study_auc_floor", f"WITH {SAMPLES_SQL}, {_FLOOR_SQL.format(src='samples')}")
def study_auc_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.study_auc_floor(samples(spark, sf_dir), "Case"))


@register("study_auc_floor_lines", f"WITH {LINES_SQL}, {_FLOOR_SQL.format(src='lines')}")
def study_auc_floor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.study_auc_floor(lines(spark, sf_dir), "Case"))


@register(
    "missingness",
    f"""WITH {LONG_SQL} SELECT feature, {rnd('100e0 * avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END)', 'missing_pct')}
FROM long GROUP BY feature HAVING count(*) > count(value)""",
)
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.missingness(samples(spark, sf_dir), TEXT_FEATURES))


def _correlation_sql(source: str, features: Sequence[str]) -> str:
    def one(x: str, y: str) -> str:
        r = f"regr_sxy({x}, {y}) / nullif(sqrt(regr_sxx({x}, {y}) * regr_syy({x}, {y})), 0)"
        return f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {rnd(r, 'r')} FROM {source}"

    return " UNION ALL ".join(one(x, y) for x in features for y in features)


@register("correlation", f"WITH {SAMPLES_SQL} {_correlation_sql('samples', TEXT_FEATURES)}")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(samples(spark, sf_dir), TEXT_FEATURES))


@register("correlation_lines", _correlation_sql("lineitem", LINE_FEATURES))
def correlation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(table(spark, sf_dir, "lineitem"), LINE_FEATURES))


@register(
    "correlation_wide",
    """WITH cells AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
pairs AS (SELECT a.j AS i, b.j AS j, a.v AS x, b.v AS y FROM cells a JOIN cells b USING (vec_id))
SELECT 'v' || i AS feature_x, 'v' || j AS feature_y,
       round(regr_sxy(x, y) / nullif(sqrt(regr_sxx(x, y) * regr_syy(x, y)), 0), 6) + 0e0 AS r
FROM pairs GROUP BY i, j""",
)
def correlation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = vector_columns(spark, sf_dir)
    return rounded(stats.correlation(df, names))


# --- group comparison and batch markers -------------------------------------------------------


_LINE_RANKS_SQL = f"""{LINES_SQL},
long AS (SELECT sample_id, study, diagnosis, feature, value
  FROM lines UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
            + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS r FROM long)"""

_MW_SQL = """sums AS (
  SELECT feature, count(*) * 1e0 AS n, count(*) FILTER (diagnosis = 'Control') * 1e0 AS n1,
         sum(r) FILTER (diagnosis = 'Control') AS r1
  FROM ranked GROUP BY feature),
ties AS (SELECT feature, sum(c * c * c - c) AS t, max(c) AS biggest
         FROM (SELECT feature, value, count(*) * 1e0 AS c FROM ranked GROUP BY 1, 2) GROUP BY feature),
u AS (SELECT feature, n, n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u1, t, biggest FROM sums JOIN ties USING (feature)),
mw AS (SELECT feature, n1, n2, biggest > 1 AS has_ties, u1,
       (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5e0) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u)"""


@register(
    "mann_whitney",
    f"""WITH {LONG_SQL}, {_MW_SQL} SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, has_ties,
{rnd('u1', 'u1')}, {rnd('z', 'z')} FROM mw""",
)
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mann_whitney(samples(spark, sf_dir), TEXT_FEATURES, CLASSES).drop("mannwhitney_p"))


# Fixed value: two-sided 5% point of the normal distribution.
_Z_05 = "1.959963984540054e0"


@register(
    "group_comparison",
    f"""WITH {LONG_SQL}, {_MW_SQL},
means AS (SELECT feature, avg(value) FILTER (diagnosis = 'Control') AS c0, avg(value) FILTER (diagnosis = 'Case') AS c1
          FROM long GROUP BY feature)
SELECT feature, {rnd('c0', '"Control"')}, {rnd('c1', '"Case"')},
       CASE WHEN c0 >= c1 THEN 'Control' ELSE 'Case' END AS highest_in, coalesce(z > {_Z_05}, false) AS significant
FROM means JOIN mw USING (feature)""",
)
def group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_comparison(samples(spark, sf_dir), TEXT_FEATURES, CLASSES)
    return rounded(out.drop("mannwhitney_p"))


@register(
    "group_comparison_lines",
    f"""WITH {_LINE_RANKS_SQL}, {_MW_SQL},
means AS (SELECT feature, avg(value) FILTER (diagnosis = 'Control') AS c0, avg(value) FILTER (diagnosis = 'Case') AS c1
          FROM long GROUP BY feature)
SELECT feature, {rnd('c0', '"Control"')}, {rnd('c1', '"Case"')},
       CASE WHEN c0 >= c1 THEN 'Control' ELSE 'Case' END AS highest_in, coalesce(z > {_Z_05}, false) AS significant
FROM means JOIN mw USING (feature)""",
)
def group_comparison_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_comparison(lines(spark, sf_dir), LINE_FEATURES, CLASSES)
    return rounded(out.drop("mannwhitney_p"))


@register(
    "group_means_long",
    f"""WITH {LONG_SQL} SELECT feature, diagnosis, {rnd('avg(value)', 'mean')} FROM long GROUP BY 1, 2""",
)
def group_means_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.group_means(samples(spark, sf_dir), TEXT_FEATURES, CLASSES)
    return rounded(stats.group_means_long(means, CLASSES))


@register(
    "anova_f",
    f"""WITH {LONG_SQL},
g AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2),
w AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * v) AS within, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1)
SELECT feature, {rnd('(SELECT sum(g.n * (g.m - w.grand) ** 2) FROM g WHERE g.feature = w.feature) / (k - 1) / (within / (n - k))', 'f_score')}
FROM w""",
)
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.anova_f(samples(spark, sf_dir), TEXT_FEATURES))


@register(
    "population_scaler",
    f"""WITH {LINES_SQL} SELECT sample_id, {', '.join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) + 0e0 AS {c}" for c in LINE_FEATURES)}
FROM lines""",
)
def population_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaling stage of the pipeline on whole rows: population deviation, constant columns become 0."""
    rows = VectorAssembler(inputCols=list(LINE_FEATURES), outputCol="assembled").transform(lines(spark, sf_dir))
    scaled = PopulationScaler().fit(rows).transform(rows).select("sample_id", vector_to_array("scaled").alias("s"))
    return rounded(scaled.select("sample_id", *[F.col("s")[i].alias(c) for i, c in enumerate(LINE_FEATURES)]))


@register(
    "mann_whitney_exact",
    """WITH v AS (SELECT vec_id < 2 AS few, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
long AS (SELECT few, 'x' AS feature, x AS v FROM v UNION ALL SELECT few, 'y', y FROM v),
r AS (SELECT feature, few, rank() OVER (PARTITION BY feature ORDER BY v) AS r, count(*) OVER (PARTITION BY feature) AS n,
  count(*) OVER (PARTITION BY feature, v) AS same FROM long),
u AS (SELECT feature, max(n) AS n, sum(r) FILTER (few) - 3 AS u, max(same) AS tie FROM r GROUP BY feature),
tail AS (SELECT feature, n, tie, greatest(u, 2 * (n - 2) - u) AS u FROM u),
ways AS (SELECT feature, sum(greatest(0, n - greatest(i + 1, u + 3 - i) + 1)) AS hits
  FROM tail, LATERAL (SELECT unnest(range(1, n)) AS i) GROUP BY feature)
SELECT feature, CAST(u AS DOUBLE) AS u_max, tie > 1 AS has_ties,
round(least(1e0, 2 * hits / (n * (n - 1) / 2e0)), 9) + 0e0 AS mannwhitney_p FROM tail JOIN ways USING (feature)""",
)
def mann_whitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors against all others, without ties: the p-value comes from counting arrangements."""
    rows = vectors(spark, sf_dir).select(
        F.when(F.col("sample_id") < 2, "few").otherwise("many").alias("diagnosis"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")
    )
    out = stats.mann_whitney(rows, ["x", "y"], ["few", "many"])
    top = F.greatest(F.col("u1"), F.col("n1") * F.col("n2") - F.col("u1"))
    p = F.round("mannwhitney_p", 9) + F.lit(0.0)
    return out.select("feature", top.cast("double").alias("u_max"), "has_ties", p.alias("mannwhitney_p"))


@register(
    "select_k_best",
    """WITH long AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value,
  unnest(range(4)) AS place FROM lineitem),
g AS (SELECT place, label, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2),
w AS (SELECT place, count(*) AS k, sum(n) AS n, sum(n * v) AS within, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
f AS (SELECT place, (SELECT sum(g.n * (g.m - w.grand) ** 2) FROM g WHERE g.place = w.place) / (k - 1) / (within / (n - k)) AS f FROM w)
SELECT ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][place + 1] AS feature, round(f, 6) + 0e0 AS f_score
FROM f ORDER BY f DESC, place LIMIT 2""",
)
def select_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the pipeline's own selection stage keeps, with the scores it ranks them by."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), *LINE_FEATURES)
    vectors_ = VectorAssembler(inputCols=list(LINE_FEATURES), outputCol="scaled").transform(rows)
    stage = FScoreSelector(2)
    scores, kept = stage.scores(vectors_), stage.fit(vectors_).getIndices()
    return rounded(spark.createDataFrame([(LINE_FEATURES[i], float(scores[i])) for i in kept], "feature string, f_score double"))


@register(
    "top_k_features",
    f"""WITH {LONG_SQL},
g AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2),
w AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * v) AS within, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
f AS (SELECT feature, {rnd('(SELECT sum(g.n * (g.m - w.grand) ** 2) FROM g WHERE g.feature = w.feature) / (k - 1) / (within / (n - k))', 'f_score')} FROM w)
SELECT * FROM f ORDER BY f_score DESC, feature LIMIT 3""",
)
def top_k_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_features(rounded(stats.anova_f(samples(spark, sf_dir), TEXT_FEATURES)), 3)


@register(
    "average_ranks",
    f"""WITH {LONG_SQL} SELECT l.sample_id, l.feature, r AS avg_rank
FROM long l LEFT JOIN ranked r ON l.sample_id = r.sample_id AND l.feature = r.feature""",
)
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = prep.to_long(samples(spark, sf_dir), ["sample_id"], TEXT_FEATURES)
    ranked = ranks.average_rank(long, ["feature"], "value", n_groups=len(TEXT_FEATURES))
    return ranked.select("sample_id", "feature", "avg_rank")


def _markers_sql(source: str) -> str:
    return f"""auc_s AS (
  SELECT r.feature, s.study, count(*) FILTER (r.study = s.study) * 1e0 AS n1, count(*) * 1e0 AS n,
         sum(r) FILTER (r.study = s.study) AS r1
  FROM ranked r, (SELECT DISTINCT study FROM {source}) s GROUP BY 1, 2),
by_study AS (
  SELECT feature, max(greatest(a, 1 - a)) AS auc_predicts_study
  FROM (SELECT feature, (r1 - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0) AS a FROM auc_s) GROUP BY feature),
auc_d AS (
  SELECT feature, count(*) FILTER (diagnosis = 'Case') * 1e0 AS n1, count(*) * 1e0 AS n,
         sum(r) FILTER (diagnosis = 'Case') AS r1 FROM ranked GROUP BY feature),
by_class AS (
  SELECT feature, greatest(a, 1 - a) AS auc_predicts_diagnosis
  FROM (SELECT feature, (r1 - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0) AS a FROM auc_d)),
markers AS (
  SELECT feature, auc_predicts_study, auc_predicts_diagnosis,
         auc_predicts_study > auc_predicts_diagnosis AS batch_dominated,
         CASE WHEN auc_predicts_study > 0.9e0 THEN 'SEVERE' WHEN auc_predicts_study > 0.75e0 THEN 'high' ELSE '' END AS risk
  FROM by_study JOIN by_class USING (feature))"""


_MARKERS_OUT = f"""SELECT feature, {rnd('auc_predicts_study', 'auc_predicts_study')},
{rnd('auc_predicts_diagnosis', 'auc_predicts_diagnosis')}, batch_dominated, risk FROM markers"""


@register("batch_markers", f"WITH {LONG_SQL}, {_markers_sql('samples')} {_MARKERS_OUT}")
def batch_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.batch_markers(samples(spark, sf_dir), TEXT_FEATURES, "Case"))


@register("batch_markers_lines", f"WITH {_LINE_RANKS_SQL}, {_markers_sql('lines')} {_MARKERS_OUT}")
def batch_markers_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.batch_markers(lines(spark, sf_dir), LINE_FEATURES, "Case"))


@register(
    "batch_summary",
    f"""WITH {LONG_SQL}, {_markers_sql('samples')}
SELECT count(*) FILTER (batch_dominated) AS n_study_dominated, count(*) AS n_features,
       coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (risk = 'SEVERE'), '') AS severe FROM markers""",
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.batch_summary(stats.batch_markers(samples(spark, sf_dir), TEXT_FEATURES, "Case"))
    return out.withColumn("severe", F.concat_ws(";", "severe"))


@register(
    "feature_auc",
    f"""WITH {LONG_SQL},
g AS (SELECT feature, count(*) FILTER (study = 'src1') * 1e0 AS n1, count(*) * 1e0 AS n,
             sum(r) FILTER (study = 'src1') AS r1 FROM ranked GROUP BY feature),
a AS (SELECT feature, (r1 - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0) AS a FROM g)
SELECT feature, {rnd('greatest(a, 1 - a)', 'auc')} FROM a""",
)
def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return rounded(stats.feature_auc(df, TEXT_FEATURES, F.col("study") == "src1"))


_EXPECTED = [
    ("e", "Case", "strong", ["first", "second"]),
    ("n", "Control", "moderate", ["second"]),
    ("z", "Control", "weak", ["third"]),
    ("unmeasured", "Case", "strong", ["first"]),
]
_EXPECT_SQL = """means AS (SELECT feature, avg(value) FILTER (diagnosis = 'Control') AS c0,
                avg(value) FILTER (diagnosis = 'Case') AS c1 FROM long GROUP BY feature),
expected(feature, expected, confidence, refs) AS (VALUES ('e', 'Case', 'strong', 'first;second'),
  ('n', 'Control', 'moderate', 'second'), ('z', 'Control', 'weak', 'third'), ('unmeasured', 'Case', 'strong', 'first')),
checked AS (SELECT feature, expected, CASE WHEN c0 >= c1 THEN 'Control' ELSE 'Case' END AS found,
  expected = CASE WHEN c0 >= c1 THEN 'Control' ELSE 'Case' END AS matches, confidence, refs
  FROM expected JOIN means USING (feature))"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.group_means(samples(spark, sf_dir), TEXT_FEATURES, CLASSES)
    return expect.check_expectations(means, expect.expectations(spark, _EXPECTED))


@register("expectation_check", f"WITH {LONG_SQL}, {_EXPECT_SQL} SELECT * FROM checked")
def expectation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).withColumn("refs", F.concat_ws(";", "refs"))


@register(
    "expectation_summary",
    f"""WITH {LONG_SQL}, {_EXPECT_SQL}
SELECT count(*) FILTER (matches) AS n_match, count(*) AS n_checked,
       count(*) FILTER (matches AND confidence IN ('strong', 'moderate')) AS n_high_match,
       count(*) FILTER (confidence IN ('strong', 'moderate')) AS n_high,
       coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (NOT matches AND confidence IN ('strong', 'moderate')), '')
         AS high_missed FROM checked""",
)
def expectation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expect.summarise_expectations(_checked(spark, sf_dir))
    return out.withColumn("high_missed", F.concat_ws(";", "high_missed"))


# --- feature columns --------------------------------------------------------------------------


def _z_sql(c: str) -> str:
    z = f"({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0)"
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce({z}, 0e0) END"


@register(
    "zscore_within_study",
    f"""WITH {SAMPLES_SQL} SELECT sample_id, study, {', '.join(rnd(_z_sql(c), c) for c in TEXT_FEATURES)}
FROM samples WINDOW w AS (PARTITION BY study)""",
)
def zscore_within_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.zscore_within(samples(spark, sf_dir), TEXT_FEATURES)
    return rounded(out.select("sample_id", "study", *TEXT_FEATURES))


@register(
    "zscore_missing_study",
    f"""WITH base AS ({SAMPLES_SQL.removeprefix('samples AS (').removesuffix(')')}),
samples AS (SELECT * REPLACE (CASE WHEN label = 1 THEN study END AS study) FROM base)
SELECT sample_id, study, {', '.join(rnd(_z_sql(c), c) for c in TEXT_FEATURES)} FROM samples WINDOW w AS (PARTITION BY study)""",
)
def zscore_missing_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without a study form a group of their own and stay in the table."""
    df = samples(spark, sf_dir).withColumn("study", F.when(F.col("label") == 1, F.col("study")))
    return rounded(prep.zscore_within(df, TEXT_FEATURES).select("sample_id", "study", *TEXT_FEATURES))


@register(
    "zscore_lines",
    f"""WITH {LINES_SQL} SELECT sample_id, study, {', '.join(rnd(_z_sql(c), c) for c in LINE_FEATURES)}
FROM lines WINDOW w AS (PARTITION BY study)""",
)
def zscore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.zscore_within(lines(spark, sf_dir), LINE_FEATURES)
    return rounded(out.select("sample_id", "study", *LINE_FEATURES))


_RATIOS = [prep.Ratio("en_ratio", "e", "n"), prep.Ratio("az_ratio", "a", "z"), prep.Ratio("eq_ratio", "e", "q")]


@register(
    "ratio_features",
    f"""WITH {SAMPLES_SQL} SELECT sample_id, {rnd('e / (n + 1e-6)', 'en_ratio')}, {rnd('a / (z + 1e-6)', 'az_ratio')}
FROM samples""",
)
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.ratio_features(samples(spark, sf_dir), _RATIOS)
    return rounded(out.select("sample_id", "en_ratio", "az_ratio"))


@register(
    "clip_and_fill",
    f"""WITH {SAMPLES_SQL},
z AS (SELECT sample_id, {', '.join(f'{_z_sql(c)} AS {c}' for c in TEXT_FEATURES)} FROM samples WINDOW w AS (PARTITION BY study)),
c AS (SELECT sample_id, {', '.join(f'CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END AS {c}' for c in TEXT_FEATURES)} FROM z)
SELECT sample_id, {', '.join(rnd(f'coalesce({c}, 0e0)', c) for c in TEXT_FEATURES)},
       {rnd('coalesce(e / (n + 1e-6), 0e0)', 'en_ratio')}, {rnd('coalesce(a / (z + 1e-6), 0e0)', 'az_ratio')} FROM c""",
)
def clip_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = prep.zscore_within(samples(spark, sf_dir), TEXT_FEATURES)
    out = prep.engineer(z, TEXT_FEATURES, _RATIOS)
    return rounded(out.select("sample_id", *TEXT_FEATURES, "en_ratio", "az_ratio"))


@register(
    "class_weights",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT label, n, {rnd('sum(n) OVER () / (count(*) OVER () * n)', 'weight')} FROM c""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.class_weights(samples(spark, sf_dir)))


# --- splits -----------------------------------------------------------------------------------


@register("holdout_split", f"WITH {SPLIT_SQL} SELECT sample_id, label, is_test FROM split")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_holdout(samples(spark, sf_dir)).select("sample_id", "label", "is_test")


@register("stratified_folds", f"WITH {SPLIT_SQL} SELECT sample_id, label, CAST(fold AS INTEGER) AS fold FROM folded")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(samples(spark, sf_dir)).select("sample_id", "label", "fold")


@register(
    "folds_with_duplicate_ids",
    f"""WITH {SAMPLES_SQL}, twice AS (SELECT sample_id // 2 AS sample_id, label FROM samples),
placed AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', sample_id)), sample_id) - 1) % 5 AS fold
  FROM twice)
SELECT label, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM placed GROUP BY label, fold""",
)
def folds_with_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples share most ids here; every row still has one fold."""
    df = samples(spark, sf_dir).withColumn("sample_id", F.floor(F.col("sample_id") / 2))
    return splits.stratified_folds(df).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register(
    "stratified_folds_lines",
    f"""WITH {LINES_SQL} SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(concat_ws('|', '42', sample_id)), sample_id) - 1) % 5 AS INTEGER) AS fold FROM lines""",
)
def stratified_folds_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(lines(spark, sf_dir)).select("sample_id", "label", "fold")


@register(
    "repeated_folds",
    f"""WITH {SAMPLES_SQL}, repeats AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS repeat)
SELECT sample_id, label, repeat, CAST((row_number() OVER (PARTITION BY repeat, label
  ORDER BY md5(concat_ws('|', repeat + 42, sample_id)), sample_id) - 1) % 5 AS INTEGER) AS fold
FROM samples, repeats""",
)
def repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.repeated_folds(samples(spark, sf_dir))


@register(
    "learning_curve_sets",
    f"""WITH {SPLIT_SQL},
train AS (SELECT sample_id, CAST(h AS INTEGER) AS holdout_fold,
  row_number() OVER (PARTITION BY h ORDER BY md5(concat_ws('|', '42', sample_id)), sample_id) AS p,
  count(*) OVER (PARTITION BY h) AS n FROM folded, range(5) t(h) WHERE fold <> h)
SELECT sample_id, holdout_fold, CASE WHEN p <= floor(0.3e0 * n + 1e-9) THEN 0.3e0 WHEN p <= floor(0.475e0 * n + 1e-9) THEN 0.475e0
  WHEN p <= floor(0.65e0 * n + 1e-9) THEN 0.65e0 WHEN p <= floor(0.825e0 * n + 1e-9) THEN 0.825e0 ELSE 1e0 END AS share FROM train""",
)
def learning_curve_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = splits.stratified_folds(samples(spark, sf_dir))
    sets = splits.learning_curve_sets(folded, (0.3, 0.475, 0.65, 0.825, 1.0))
    return sets.select("sample_id", "holdout_fold", "share")


@register(
    "study_folds",
    f"""WITH {SAMPLES_SQL}, per AS (SELECT study, label, count(*) AS n FROM samples GROUP BY 1, 2)
SELECT p.study, CAST(sum(n) AS BIGINT) AS n_test, count(*) AS test_classes,
  (SELECT count(DISTINCT label) FROM samples s WHERE s.study <> p.study) AS train_classes,
  count(*) >= 2 AND (SELECT count(DISTINCT label) FROM samples s WHERE s.study <> p.study) >= 2 AS usable
FROM per p GROUP BY p.study""",
)
def study_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.study_folds(samples(spark, sf_dir))


# --- curves and thresholds --------------------------------------------------------------------


_CUTS_SQL = f"""{SAMPLES_SQL},
g AS (SELECT e AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM samples GROUP BY e),
cuts AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos,
                sum(neg) OVER () AS n_neg
         FROM g WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
points AS (SELECT *, tp / n_pos AS tpr, fp / n_neg AS fpr, tp / (tp + fp) AS prec FROM cuts)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", "label", F.col("e").alias("score"))


@register("roc_points", f"WITH {_CUTS_SQL} SELECT {rnd('threshold', 'threshold')}, {rnd('fpr', 'fpr')}, {rnd('tpr', 'tpr')} FROM points")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.roc_points(_scores(spark, sf_dir)))


@register("pr_points", f"WITH {_CUTS_SQL} SELECT {rnd('threshold', 'threshold')}, {rnd('prec', 'precision')}, {rnd('tpr', 'recall')} FROM points")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.pr_points(_scores(spark, sf_dir)))


@register("auc", f"WITH {_CUTS_SQL} SELECT {rnd('sum(neg * (tp - pos / 2)) / (max(n_pos) * max(n_neg))', 'auc')} FROM points")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.auc(_scores(spark, sf_dir)))


@register(
    "auc_by_study",
    """WITH r AS (SELECT l_linestatus AS study, l_returnflag = 'R' AS y, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice)
  + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2e0 AS r FROM lineitem),
s AS (SELECT study, count(*) FILTER (y) * 1e0 AS n1, count(*) * 1e0 AS n, sum(r) FILTER (y) AS r1 FROM r GROUP BY study)
SELECT study, round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) + 0e0 AS auc FROM s""",
)
def auc_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.auc(lines(spark, sf_dir), "l_extendedprice", "label", ["study"]))


@register("threshold_fixed", f"WITH {SAMPLES_SQL} SELECT sample_id, label, CAST(e >= 10e0 AS INTEGER) AS prediction FROM samples")
def threshold_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.apply_threshold(_scores(spark, sf_dir), 10.0).select("sample_id", "label", "prediction")


@register(
    "threshold_f1",
    f"""WITH {_CUTS_SQL}, f AS (SELECT threshold, CASE WHEN prec + tpr > 0 THEN round(2 * prec * tpr / (prec + tpr + 1e-12), 12) ELSE 0e0 END AS q FROM points)
SELECT {rnd('q', 'quality')}, {rnd('threshold', 'threshold')} FROM f ORDER BY q DESC, f.threshold LIMIT 1""",
)
def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.threshold_f1(_scores(spark, sf_dir)))


@register(
    "threshold_f2",
    f"""WITH {_CUTS_SQL}, f AS (SELECT threshold, round(5 * tp / (5 * tp + 4 * (n_pos - tp) + fp), 12) AS q FROM points)
SELECT {rnd('q', 'quality')}, {rnd('threshold', 'threshold')} FROM f ORDER BY q DESC, f.threshold LIMIT 1""",
)
def threshold_f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.threshold_f2(_scores(spark, sf_dir)))


@register(
    "threshold_youden",
    f"""WITH {_CUTS_SQL}, f AS (SELECT threshold, round(tpr - fpr, 12) AS q FROM points)
SELECT {rnd('q', 'quality')}, {rnd('CASE WHEN q > 0 THEN threshold ELSE 0.5e0 END', 'threshold')} FROM f ORDER BY q DESC, f.threshold DESC LIMIT 1""",
)
def threshold_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.threshold_youden(_scores(spark, sf_dir)))


@register(
    "threshold_sensitivity",
    f"WITH {_CUTS_SQL} SELECT {rnd('coalesce(max(threshold) FILTER (tpr >= 0.85e0), 0.5e0)', 'threshold')} FROM points",
)
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.threshold_sensitivity(_scores(spark, sf_dir)))


def class_scores() -> Column:
    """Ten class scores from all coordinates: the sum of every tenth one."""
    picked = lambda c: F.filter("vec", lambda v, j: j % 10 == c)
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(picked(c), F.lit(0.0), lambda a, v: a + v))


_SCORES_SQL = """(SELECT label, list_transform(range(10), lambda c: list_reduce(list_transform(range(c, len(embedding), 10),
  lambda j: CAST(embedding[j + 1] AS DOUBLE)), lambda a, b: a + b)) AS scores FROM embeddings)"""


@register(
    "ovr_auc",
    f"""WITH s AS (SELECT c, label = c AS y, scores[c + 1] AS v FROM {_SCORES_SQL}, range(10) t(c)),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2e0 AS r FROM s),
g AS (SELECT c, count(*) FILTER (y) * 1e0 AS n1, count(*) * 1e0 AS n, sum(r) FILTER (y) AS r1 FROM r GROUP BY c)
SELECT 'c' || c AS class, round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) + 0e0 AS auc FROM g WHERE n1 > 0""",
)
def ovr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("label", class_scores().alias("probability"))
    return rounded(curves.ovr_auc(scored, VECTOR_CLASSES))


# --- evaluation -------------------------------------------------------------------------------


_PRED_SQL = f"{SAMPLES_SQL}, pred AS (SELECT label, CAST(e >= 10e0 AS INTEGER) AS prediction FROM samples)"
_ARGMAX_SQL = f"""pred AS (SELECT label, list_position(scores, list_max(scores)) - 1 AS prediction FROM {_SCORES_SQL})"""


_PRED_EXAMPLE_SQL = f"{SAMPLES_SQL}, pred AS (SELECT sample_id, CAST(e >= 10e0 AS INTEGER) AS prediction FROM samples)"


def _argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("label", class_scores().alias("s"))
    return scored.select(
        "label", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("prediction")
    )


def _per_sql(k: int) -> str:
    return f"""per AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c) AS support, (SELECT count(*) FROM pred WHERE prediction = c) AS guessed,
  (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS hits FROM range({k}) t(c)),
pr AS (SELECT *, coalesce(hits / nullif(guessed, 0), 0e0) AS p, coalesce(hits / nullif(support, 0), 0e0) AS r FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0e0) AS f1 FROM pr)"""


_REPORT_SQL = """SELECT {name} AS class, round(p, 6) + 0e0 AS precision, round(r, 6) + 0e0 AS recall, round(f1, 6) + 0e0 AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""
_MEASURES_SQL = """SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) + 0e0 AS accuracy,
round(avg(r) FILTER (support > 0), 6) + 0e0 AS balanced_accuracy, round(max(f1) FILTER (c = {positive}), 6) + 0e0 AS f1,
round(avg(f1) FILTER (support > 0 OR guessed > 0), 6) + 0e0 AS f1_macro,
round(sum(f1 * support) / sum(support), 6) + 0e0 AS f1_weighted FROM f"""
_NAME2 = "CASE c WHEN 0 THEN 'Control' ELSE 'Case' END"


def _binary_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(curves.apply_threshold(_scores(spark, sf_dir), 10.0), CLASSES)


@register(
    "confusion",
    f"""WITH {_PRED_SQL} SELECT CASE a WHEN 0 THEN 'Control' ELSE 'Case' END AS actual,
CASE b WHEN 0 THEN 'Control' ELSE 'Case' END AS predicted,
(SELECT count(*) FROM pred WHERE label = a AND prediction = b) AS n FROM range(2) x(a), range(2) y(b)""",
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary_confusion(spark, sf_dir)


@register(
    "confusion_multiclass",
    f"""WITH {_ARGMAX_SQL} SELECT 'c' || a AS actual, 'c' || b AS predicted,
(SELECT count(*) FROM pred WHERE label = a AND prediction = b) AS n FROM range(10) x(a), range(10) y(b)""",
)
def confusion_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_argmax(spark, sf_dir), VECTOR_CLASSES)


@register(
    "confusion_stray_label",
    f"""WITH {_ARGMAX_SQL} SELECT 'c' || a AS actual, 'c' || b AS predicted,
(SELECT count(*) FROM pred WHERE label = a AND prediction = b) AS n FROM range(7) x(a), range(7) y(b)""",
)
def confusion_stray_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven of ten classes are declared; rows of the others do not count."""
    return evaluate.confusion(_argmax(spark, sf_dir), VECTOR_CLASSES[:7])


@register("class_report", f"WITH {_PRED_SQL}, {_per_sql(2)} {_REPORT_SQL.format(name=_NAME2)}")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_report(_binary_confusion(spark, sf_dir)))


@register("class_report_multiclass", f"""WITH {_ARGMAX_SQL}, {_per_sql(10)} {_REPORT_SQL.format(name="'c' || c")}""")
def class_report_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_report(evaluate.confusion(_argmax(spark, sf_dir), VECTOR_CLASSES)))


@register("measures", f"WITH {_PRED_SQL}, {_per_sql(2)} {_MEASURES_SQL.format(positive=1)}")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.measures(_binary_confusion(spark, sf_dir), "Case"))


@register("measures_multiclass", f"WITH {_ARGMAX_SQL}, {_per_sql(10)} {_MEASURES_SQL.format(positive=9)}")
def measures_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.measures(evaluate.confusion(_argmax(spark, sf_dir), VECTOR_CLASSES), "c9"))


def _cut_measures_sql(cut: str, at: str) -> str:
    return f"""SELECT '{cut}' AS cut, * FROM (WITH pred AS (SELECT label, CAST(e >= {at} AS INTEGER) AS prediction FROM samples),
{_per_sql(2)} {_MEASURES_SQL.format(positive=1)})"""


@register(
    "evaluate_cuts",
    f"WITH {SAMPLES_SQL} {_cut_measures_sql('default', '10e0')} UNION ALL {_cut_measures_sql('tuned', '8.5e0')}",
)
def evaluate_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate_cuts(_scores(spark, sf_dir), CLASSES, {"default": 10.0, "tuned": 8.5}))


# --- neighbours and models --------------------------------------------------------------------


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = splits.stratified_holdout(samples(spark, sf_dir)).persist()
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")


_DIST_SQL = " + ".join(f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in FULL_FEATURES)


@register(
    "knn_vote",
    f"""WITH {SPLIT_SQL},
near AS (SELECT q.sample_id, d.label, row_number() OVER (PARTITION BY q.sample_id ORDER BY {_DIST_SQL}, d.sample_id) AS rk
  FROM split q, split d WHERE q.is_test AND NOT d.is_test)
SELECT sample_id, {rnd('avg(label)', 'score')}, CAST(avg(label) > 0.5e0 AS INTEGER) AS prediction FROM near WHERE rk <= 5 GROUP BY sample_id""",
)
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(*_train_test(spark, sf_dir))


def _vote(train: DataFrame, test: DataFrame) -> DataFrame:
    donors = train.select(
        F.col("sample_id").alias("donor_id"), neighbours.with_nan(FULL_FEATURES).alias("vec"), "label"
    )
    index = neighbours.NeighbourIndex(neighbours.limit_copies(donors, 5), len(FULL_FEATURES))
    asked = test.select(F.col("sample_id").alias("query_id"), neighbours.with_nan(FULL_FEATURES).alias("vec"))
    votes = neighbours.knn_vote(index, asked, 5, 2)
    return rounded(
        votes.select(
            F.col("query_id").alias("sample_id"),
            F.col("votes")[1].alias("score"),
            F.col("prediction").cast("int").alias("prediction"),
        )
    )


@register(
    "knn_vote_small_values",
    f"""WITH {SPLIT_SQL},
tiny AS (SELECT sample_id, label, is_test, {', '.join(f'{c} / 1e6 AS {c}' for c in FULL_FEATURES)} FROM split),
near AS (SELECT q.sample_id, d.label, row_number() OVER (PARTITION BY q.sample_id ORDER BY {_DIST_SQL}, d.sample_id) AS rk
  FROM tiny q, tiny d WHERE q.is_test AND NOT d.is_test)
SELECT sample_id, {rnd('avg(label)', 'score')}, CAST(avg(label) > 0.5e0 AS INTEGER) AS prediction FROM near WHERE rk <= 5 GROUP BY sample_id""",
)
def knn_vote_small_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vote on values a million times smaller: distances are compared as they are."""
    return _vote(*(part.withColumns({c: F.col(c) / 1e6 for c in FULL_FEATURES}) for part in _train_test(spark, sf_dir)))


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns with gaps: flagged documents miss ``a``, one study never measured ``n``."""
    df = samples(spark, sf_dir)
    return df.withColumn("n", F.when(F.col("study") != "src7", F.col("n")))


def _nan_dist_sql() -> str:
    terms = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0e0)" for c in TEXT_FEATURES)
    common = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1e0 ELSE 0e0 END" for c in TEXT_FEATURES)
    return f"({terms}) * (5e0 / nullif({common}, 0e0))"


def _impute_sql(c: str) -> str:
    return f"""fill_{c} AS (SELECT sample_id, avg(v) AS v FROM (
  SELECT q.sample_id, d.{c} AS v, row_number() OVER (PARTITION BY q.sample_id ORDER BY {_nan_dist_sql()}, d.sample_id) AS rk
  FROM holed q, holed d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL) WHERE rk <= 5 GROUP BY sample_id)"""


@register(
    "knn_impute",
    f"""WITH {SAMPLES_SQL}, holed AS (SELECT * REPLACE (CASE WHEN study <> 'src7' THEN n END AS n) FROM samples),
{_impute_sql('a')}, {_impute_sql('n')}
SELECT h.sample_id, {rnd('h.e', 'e')}, {rnd('coalesce(h.n, fn.v)', 'n')}, {rnd('h.t', 't')},
       {rnd('coalesce(h.a, fa.v)', 'a')}, {rnd('h.z', 'z')}
FROM holed h LEFT JOIN fill_a fa ON fa.sample_id = h.sample_id LEFT JOIN fill_n fn ON fn.sample_id = h.sample_id""",
)
def knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _holed(spark, sf_dir)
    model = KNNImputer(TEXT_FEATURES).fit(df)
    return rounded(model.transform(df).select("sample_id", *TEXT_FEATURES))


def _bayes_sql(train: str, keys: str = "") -> str:
    """Gaussian class statistics of a training table: smoothed by 1e-9 of the column variance."""
    group = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    stat = ", ".join(
        f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}, sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in FULL_FEATURES
    )
    smooth = ", ".join(
        f"v_{c} + 1e-9 * (sum(q_{c}) OVER w / sum(n) OVER w - (sum(s_{c}) OVER w / sum(n) OVER w) ** 2) AS v_{c}"
        for c in FULL_FEATURES
    )
    means = ", ".join(f"m_{c}" for c in FULL_FEATURES)
    return f"""raw_stats AS (SELECT {group}label, count(*) AS n, {stat} FROM {train} GROUP BY {group}label),
nb AS (SELECT {group}label, ln(n / sum(n) OVER w) AS prior, {means}, {smooth} FROM raw_stats WINDOW w AS ({over}))"""


def _loglik_sql(row: str, stat: str) -> str:
    return f"{stat}.prior + " + " + ".join(
        f"(-0.5e0 * (ln(2 * pi() * {stat}.v_{c}) + ({row}.{c} - {stat}.m_{c}) ** 2 / {stat}.v_{c}))" for c in FULL_FEATURES
    )


def _posterior_sql(rows: str, keys: str, join: str = "true") -> str:
    """P(label = 1) of every row of ``rows``, which must carry ``keys``."""
    return f"""SELECT {keys}, 1 / (1 + exp(sum(CASE WHEN label_c = 0 THEN ll ELSE -ll END))) AS score
FROM (SELECT r.*, nb.label AS label_c, {_loglik_sql('r', 'nb')} AS ll FROM {rows} r JOIN nb ON {join}) GROUP BY {keys}"""


def _bayes_recipe() -> Recipe:
    return Recipe(features=FULL_FEATURES, classes=CLASSES, ratios=None, impute=False, select_k="all")


_BAYES = zoo.binary_models()["GaussianNB"]


@register(
    "gaussian_nb_scores",
    f"""WITH {SPLIT_SQL}, train AS (SELECT * FROM split WHERE NOT is_test), {_bayes_sql('train')},
test AS (SELECT sample_id, label AS y, e, n, t, z FROM split WHERE is_test), scored AS ({_posterior_sql('test', 'sample_id, y')})
SELECT sample_id, y AS label, {rnd('score', 'score')}, CAST(score > 0.5e0 AS INTEGER) AS prediction FROM scored""",
)
def gaussian_nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    recipe = _bayes_recipe()
    with selection.prepared(recipe, train) as fold:
        model = selection.whole_model(fold, selection.fit_on(recipe, _BAYES, fold))
    return rounded(selection.score(model, test, ["sample_id", "label"]).drop("probability"))


@register(
    "oof_scores",
    f"""WITH {SPLIT_SQL}, train AS (SELECT h, s.* FROM folded s, range(5) t(h) WHERE fold <> h), {_bayes_sql('train', 'h')},
test AS (SELECT sample_id, label AS y, fold, e, n, t, z FROM folded),
scored AS ({_posterior_sql('test', 'sample_id, y', 'nb.h = r.fold')})
SELECT sample_id, y AS label, {rnd('score', 'score')} FROM scored""",
)
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.out_of_fold(_bayes_recipe(), samples(spark, sf_dir), _BAYES)
    return rounded(out.select("sample_id", "label", "score"))


@register(
    "loso_report",
    f"""WITH {SAMPLES_SQL}, usable AS (SELECT study FROM samples GROUP BY study HAVING count(DISTINCT label) = 2),
train AS (SELECT u.study AS h, s.* FROM samples s, usable u WHERE s.study <> u.study), {_bayes_sql('train', 'h')},
test AS (SELECT sample_id, study, label AS y, e, n, t, z FROM samples SEMI JOIN usable USING (study)),
scored AS ({_posterior_sql('test', 'sample_id, study, y', 'nb.h = r.study')}),
ranked AS (SELECT *, rank() OVER (PARTITION BY study ORDER BY score) + (count(*) OVER (PARTITION BY study, score) - 1) / 2e0 AS r FROM scored),
g AS (SELECT study, count(*) AS n_test, count(*) FILTER (y = 1) * 1e0 AS n1, count(*) FILTER (y = 0) * 1e0 AS n0,
  sum(r) FILTER (y = 1) AS r1, avg(CASE WHEN score >= 0.5e0 THEN 1e0 ELSE 0e0 END) FILTER (y = 1) AS tpr,
  avg(CASE WHEN score < 0.5e0 THEN 1e0 ELSE 0e0 END) FILTER (y = 0) AS tnr FROM ranked GROUP BY study)
SELECT study, n_test, {rnd('(r1 - n1 * (n1 + 1) / 2) / (n1 * n0)', 'auc')}, {rnd('(tpr + tnr) / 2', 'balanced_accuracy')} FROM g""",
)
def loso_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.leave_one_study_out(_bayes_recipe(), samples(spark, sf_dir), _BAYES))


def _shap_sql(out: str) -> str:
    mixed = ", ".join(
        f"CASE WHEN (m >> {j}) & 1 = 1 THEN x.{c} ELSE b.{c} END AS {c}" for j, c in enumerate(FULL_FEATURES)
    )
    return f"""WITH {SPLIT_SQL}, train AS (SELECT * FROM split WHERE NOT is_test), {_bayes_sql('train')},
back AS (SELECT sample_id AS bid, e, n, t, z FROM train ORDER BY md5(concat_ws('|', '42', sample_id)) LIMIT 50),
mixed AS (SELECT x.sample_id, b.bid, m, {mixed} FROM split x, back b, range(16) q(m) WHERE x.is_test),
scored AS ({_posterior_sql('mixed', 'sample_id, bid, m')}),
v AS (SELECT sample_id, m, avg(score) AS v FROM scored GROUP BY 1, 2),
phi AS (SELECT a.sample_id, j, sum((b.v - a.v) * CASE bit_count(a.m) WHEN 0 THEN 6e0 WHEN 1 THEN 2e0 WHEN 2 THEN 2e0 ELSE 6e0 END / 24) AS phi
  FROM v a, range(4) t(j), v b WHERE (a.m >> j) & 1 = 0 AND b.sample_id = a.sample_id AND b.m = a.m + (1 << j) GROUP BY 1, 2),
named AS (SELECT sample_id, CASE j WHEN 0 THEN 'e' WHEN 1 THEN 'n' WHEN 2 THEN 't' ELSE 'z' END AS feature, phi, v AS base_value
  FROM phi JOIN v USING (sample_id) WHERE m = 0) {out}"""


def _shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    recipe = _bayes_recipe()
    with selection.prepared(recipe, train) as fold:
        model = selection.whole_model(fold, selection.fit_on(recipe, _BAYES, fold))
    background = explain.sampled_background(train, FULL_FEATURES)
    return explain.kernel_shap(model, test, FULL_FEATURES, background)


@register(
    "shap_values",
    _shap_sql(f"SELECT sample_id, 1 AS class, feature, {rnd('phi', 'phi')}, {rnd('base_value', 'base_value')} FROM named"),
)
def shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shap(spark, sf_dir))


@register(
    "shap_importance",
    _shap_sql(f"SELECT feature, {rnd('avg(abs(phi))', 'mean_abs_shap')} FROM named GROUP BY feature"),
)
def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.shap_importance(_shap(spark, sf_dir)))


@register(
    "row_contributions",
    _shap_sql(f"""SELECT feature, {rnd('phi', 'phi')}, {rnd('base_value', 'base_value')} FROM named
WHERE sample_id = (SELECT min(sample_id) FROM named)"""),
)
def row_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the features push the first scored sample away from the base value."""
    values = _shap(spark, sf_dir).persist()
    first = values.agg(F.min("sample_id")).first()[0]
    return rounded(explain.row_contributions(values, first).select("feature", "phi", "base_value"))


@register(
    "example_per_class",
    f"WITH {_PRED_EXAMPLE_SQL} SELECT prediction, min(sample_id) AS sample_id FROM pred GROUP BY prediction",
)
def example_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sample that is predicted as each class."""
    return explain.example_per_class(curves.apply_threshold(_scores(spark, sf_dir), 10.0)).select("prediction", "sample_id")


@register("lime_weights")
def lime_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    train = train.select("sample_id", "label", *FULL_FEATURES).persist()
    stages = [VectorAssembler(inputCols=list(FULL_FEATURES), outputCol="features"), NaiveBayes(modelType="gaussian")]
    model = Pipeline(stages=stages).fit(train)
    return explain.lime(model, train, test, FULL_FEATURES)


# Fixed value: repeats of the published three-class run.
MULTICLASS_REPEATS = 3


def _text_recipe() -> Recipe:
    return Recipe(features=TEXT_FEATURES, classes=CLASSES, ratios=_RATIOS, select_k="all")


@register("leaderboard")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All binary models with the published folds and repeats."""
    return selection.screen_models(_text_recipe(), samples(spark, sf_dir), zoo.binary_models())


@register("leaderboard_multiclass")
def leaderboard_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three-class models with the published folds and repeats."""
    df, names = vector_columns(spark, sf_dir)
    recipe = Recipe(features=names, classes=VECTOR_CLASSES, ratios=None, select_k="all")
    return selection.screen_models(recipe, df, zoo.multiclass_models(), repeats=MULTICLASS_REPEATS)


@register("grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published grid of every binary model that has one, with the published folds and repeats."""
    recipe, table = _text_recipe(), samples(spark, sf_dir)
    entries = {name: entry for name, entry in zoo.binary_models().items() if entry.grid}

    def one(name):
        grid, means = selection.grid_scores(recipe, table, entries[name], select=zoo.SELECT_GRID)
        return [(name, {k: str(v) for k, v in p.items()}, m) for p, m in zip(grid, means)]

    # The passes of different models overlap.
    with selection.shared_folds(), ThreadPoolExecutor(max_workers=len(entries)) as pool:
        rows = [row for part in pool.map(one, entries) for row in part]
    return spark.createDataFrame(rows, "name string, params map<string,string>, mean_score double")


@register("learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.learning_curve(_bayes_recipe(), samples(spark, sf_dir), _BAYES)


def _fitted(spark: SparkSession, sf_dir: str, name: str, params: dict):
    train, test = _train_test(spark, sf_dir)
    recipe = _text_recipe()
    with selection.prepared(recipe, train) as fold:
        fitted = selection.fit_on(recipe, zoo.binary_models()[name], fold, params)
        return selection.whole_model(fold, fitted), test


@register("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _fitted(spark, sf_dir, "RandomForest", {})
    return selection.feature_importance(model)


def _register_model(query: str, name: str, params: dict) -> None:
    @register(query)
    def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, test = _fitted(spark, sf_dir, name, params)
        return selection.score(model, test, ["sample_id", "label"]).drop("probability")


for _query, _name, _params in [
    ("logistic_scores", "LogisticRegression", {}),
    ("decision_tree_scores", "DecisionTree", {}),
    ("random_forest_scores", "RandomForest", {}),
    ("extra_trees_scores", "ExtraTrees", {}),
    ("gradient_boosting_scores", "GradientBoosting", {}),
    ("adaboost_scores", "AdaBoost", {}),
    ("rbf_svc_scores", "SVC_RBF", {}),
    ("mlp_scores", "MLP", {}),
]:
    _register_model(_query, _name, _params)


@register("logistic_scores_lines")
def logistic_scores_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.stratified_holdout(lines(spark, sf_dir)).persist()
    recipe = Recipe(features=LINE_FEATURES, classes=CLASSES, ratios=None, impute=False, select_k="all")
    with selection.prepared(recipe, split.where(~F.col("is_test"))) as fold:
        fitted = selection.fit_on(recipe, zoo.binary_models()["LogisticRegression"], fold)
        model = selection.whole_model(fold, fitted)
    return selection.score(model, split.where("is_test"), ["sample_id", "label"]).drop("probability")


@register(
    "generalisation_gap",
    f"""WITH {SPLIT_SQL}, nb_train AS (SELECT 'random_split' AS h, * EXCLUDE (is_test) FROM split WHERE NOT is_test
  UNION ALL SELECT u.study, s.* FROM samples s, (SELECT study FROM samples GROUP BY study HAVING count(DISTINCT label) = 2) u WHERE s.study <> u.study),
{_bayes_sql('nb_train', 'h')},
test AS (SELECT 'random_split' AS h, sample_id, label AS y, e, n, t, z FROM split WHERE is_test
  UNION ALL SELECT study, sample_id, label, e, n, t, z FROM samples
  SEMI JOIN (SELECT study FROM samples GROUP BY study HAVING count(DISTINCT label) = 2) u USING (study)),
scored AS ({_posterior_sql('test', 'sample_id, r.h, y', 'nb.h = r.h').replace('r.h,', 'h,', 1).replace('GROUP BY sample_id, r.h, y', 'GROUP BY sample_id, h, y')}),
ranked AS (SELECT *, rank() OVER (PARTITION BY h ORDER BY score) + (count(*) OVER (PARTITION BY h, score) - 1) / 2e0 AS r FROM scored),
g AS (SELECT h, count(*) FILTER (y = 1) * 1e0 AS n1, count(*) FILTER (y = 0) * 1e0 AS n0, sum(r) FILTER (y = 1) AS r1 FROM ranked GROUP BY h),
a AS (SELECT h, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g)
SELECT 'random_split' AS evaluation, {rnd("max(auc) FILTER (h = 'random_split')", 'auc')} FROM a
UNION ALL SELECT 'unseen_study', round(avg(auc) FILTER (h <> 'random_split'), 6) + 0e0 FROM a""",
)
def generalisation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    recipe = _bayes_recipe()
    with selection.prepared(recipe, train) as fold:
        model = selection.whole_model(fold, selection.fit_on(recipe, _BAYES, fold))
    random_auc = curves.auc(selection.score(model, test, ["sample_id", "label"]))
    report = selection.leave_one_study_out(recipe, samples(spark, sf_dir), _BAYES)
    return rounded(selection.generalisation_gap(random_auc, report))


# --- count tables -----------------------------------------------------------------------------


@register(
    "relative_abundance",
    f"""WITH {COUNTS_SQL} SELECT sample_id, taxon, reads,
{rnd('100e0 * reads / sum(reads) OVER (PARTITION BY sample_id)', 'share')} FROM counts""",
)
def relative_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upstream.relative_abundance(token_counts(spark, sf_dir)))


@register(
    "taxa_pivot",
    f"""WITH {COUNTS_SQL} SELECT sample_id, {', '.join(f"CAST(coalesce(sum(reads) FILTER (taxon = '{t}'), 0) AS BIGINT) AS {t}" for t in TAXA)}
FROM counts GROUP BY sample_id""".replace("AS and", 'AS "and"').replace("AS of", 'AS "of"'),
)
def taxa_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upstream.pivot_taxa(token_counts(spark, sf_dir), TAXA)


@register(
    "taxa_grouping",
    f"""WITH {COUNTS_SQL}, mapping(taxon, grp) AS (VALUES ('the', 'article'), ('la', 'article'), ('le', 'article'), ('of', 'link'), ('de', 'link'))
SELECT sample_id, grp AS taxon, CAST(sum(reads) AS BIGINT) AS reads FROM counts JOIN mapping USING (taxon) GROUP BY 1, 2""",
)
def taxa_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("the", "article"), ("la", "article"), ("le", "article"), ("of", "link"), ("de", "link")]
    mapping = spark.createDataFrame(pairs, "taxon string, column string")
    return upstream.group_taxa(token_counts(spark, sf_dir), mapping)


@register(
    "shannon",
    f"""WITH {COUNTS_SQL}, p AS (SELECT sample_id, reads / sum(reads) OVER (PARTITION BY sample_id) AS p FROM counts)
SELECT sample_id, {rnd('-sum(p * log2(p))', 'shannon')} FROM p GROUP BY sample_id""",
)
def shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upstream.shannon(token_counts(spark, sf_dir)))


_DEPTH = 100
# Each node of the tree over the leading key bits: its reads and taxa, then its draws from the root downwards.
_RAREFY_SQL = f"""{COUNTS_SQL},
keyed AS (SELECT sample_id, taxon, reads, list_aggregate(list_transform(string_split(md5(concat_ws('|', '42', sample_id, taxon))[:10], ''),
  lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][
    strpos('0123456789abcdef', c)]), 'string_agg', '') AS bits FROM counts),
tree AS (SELECT sample_id, bits[:level] AS path, CAST(sum(reads) AS BIGINT) AS reads, count(*) AS taxa
  FROM keyed, range(0, 41) AS l(level) GROUP BY 1, 2),
pairs AS (SELECT t.sample_id, t.path, t.reads AS total, coalesce(a.reads, 0) AS part,
  CAST('0x' || md5(concat_ws('|', '42', t.sample_id, t.path))[:12] AS BIGINT) / 281474976710656e0 AS u
  FROM tree t LEFT JOIN tree a ON a.sample_id = t.sample_id AND a.path = t.path || '0' WHERE t.taxa > 1 AND length(t.path) < 40),
walk AS (SELECT sample_id, '' AS path, CAST({_DEPTH} AS BIGINT) AS n FROM tree WHERE path = '' AND reads >= {_DEPTH}
  UNION ALL SELECT sample_id, path || half, CASE WHEN half = '0' THEN x ELSE n - x END
  FROM (SELECT sample_id, path, n, low + len(list_filter(range(1, len(p) + 1), lambda i: list_sum(p[:i]) <= u * list_sum(p))) AS x
    FROM (SELECT sample_id, path, n, u, greatest(0, n - (total - part)) AS low,
      list_transform(range(greatest(0, n - (total - part)), least(part, n) + 1), lambda k: exp(lgamma(part + 1) - lgamma(k + 1) - lgamma(part - k + 1)
        + lgamma(total - part + 1) - lgamma(n - k + 1) - lgamma(total - part - n + k + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1))) AS p
      FROM walk JOIN pairs USING (sample_id, path) WHERE n > 0)), (VALUES ('0'), ('1')) AS h(half)),
rare AS (SELECT sample_id, taxon, n AS reads FROM walk JOIN tree USING (sample_id, path) JOIN keyed USING (sample_id)
  WHERE taxa = 1 AND n > 0 AND starts_with(bits, path))"""


@register("rarefy", f"WITH RECURSIVE {_RAREFY_SQL} SELECT sample_id, taxon, reads FROM rare")
def rarefy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upstream.rarefy(token_counts(spark, sf_dir), _DEPTH)


@register(
    "rarefied_shannon",
    f"""WITH RECURSIVE {_RAREFY_SQL}, h AS (SELECT sample_id, -sum(p * log2(p)) AS shannon FROM (
  SELECT sample_id, reads / sum(reads) OVER (PARTITION BY sample_id) AS p FROM rare) GROUP BY sample_id)
SELECT s.sample_id, {rnd('shannon', 'shannon')} FROM (SELECT DISTINCT sample_id FROM counts) s LEFT JOIN h ON h.sample_id = s.sample_id""",
)
def rarefied_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upstream.rarefied_shannon(token_counts(spark, sf_dir), _DEPTH))


@register(
    "assemble_samples",
    f"""WITH {COUNTS_SQL},
wide AS (SELECT sample_id, 100e0 * coalesce(sum(reads) FILTER (taxon = 'the'), 0) / sum(reads) AS the,
  100e0 * coalesce(sum(reads) FILTER (taxon = 'de'), 0) / sum(reads) AS de, ln(sum(reads)) - sum(reads * ln(reads)) / sum(reads) AS h
  FROM counts GROUP BY sample_id)
SELECT doc_id AS sample_id, source AS study, {rnd('the', 'the')}, {rnd('de', 'de')}, {rnd('h / ln(2)', 'shannon')}
FROM documents LEFT JOIN wide ON doc_id = sample_id""",
)
def assemble_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark, sf_dir)
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("study"))
    return rounded(upstream.assemble_samples(counts, counts, upstream.shannon(counts), meta, ["the"], ["de"]))


@register(
    "attribute_patch",
    """SELECT d.doc_id AS sample_id, coalesce(CASE WHEN toxic = 1 THEN 'flagged' END, lang) AS sample_type
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def attribute_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_type")
    )
    lookup = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "flagged").alias("sample_type")
    )
    return upstream.patch_attribute(docs, lookup, "sample_type", lookup_key="doc_id")


@register(
    "attach_labels",
    """SELECT d.doc_id AS sample_id, coalesce(CASE quality WHEN 1 THEN 'Case' WHEN 0 THEN 'Control' END, 'unknown') AS diagnosis
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    groups = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("run_accession"),
        F.when(F.col("quality") == 1, "Case").otherwise("Control").alias("group"),
    )
    return upstream.attach_labels(docs, groups)


@register(
    "label_from_identifier",
    """SELECT o_orderkey, CASE regexp_extract(o_orderpriority, '^([0-9])-', 1) WHEN '1' THEN 'Case' WHEN '5' THEN 'Control'
ELSE 'unknown' END AS diagnosis FROM orders""",
)
def label_from_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("1", "Case"), ("5", "Control")], "prefix string, label string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    out = upstream.label_from_identifier(orders, mapping, "^([0-9])-", "o_orderpriority")
    return out.select("o_orderkey", "diagnosis")


@register(
    "study_presence",
    f"""WITH {LONG_SQL} SELECT feature, study, count(value) AS n, {rnd('count(*) FILTER (value > 0) / nullif(count(value), 0)', 'present_share')},
{rnd('median(value)', 'median')} FROM long GROUP BY 1, 2""",
)
def study_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upstream.study_presence(prep.to_long(samples(spark, sf_dir), ["study"], TEXT_FEATURES)))


@register(
    "median_spread",
    f"""WITH {LONG_SQL}, m AS (SELECT feature, study, median(value) AS m FROM long GROUP BY 1, 2)
SELECT feature, {rnd('max(m) / nullif(min(m), 0)', 'median_ratio')} FROM m GROUP BY feature""",
)
def median_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = upstream.study_presence(prep.to_long(samples(spark, sf_dir), ["study"], TEXT_FEATURES))
    return rounded(upstream.median_spread(presence))


@register(
    "quartiles",
    """SELECT 'l_extendedprice' AS feature, round(quantile_cont(l_extendedprice, 0.25), 6) + 0e0 AS q1,
round(quantile_cont(l_extendedprice, 0.5), 6) + 0e0 AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) + 0e0 AS q3 FROM lineitem
UNION ALL SELECT 'l_quantity', round(quantile_cont(l_quantity, 0.25), 6) + 0e0, round(quantile_cont(l_quantity, 0.5), 6) + 0e0,
round(quantile_cont(l_quantity, 0.75), 6) + 0e0 FROM lineitem""",
)
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = prep.to_long(lines(spark, sf_dir), [], ["l_extendedprice", "l_quantity"])
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    return rounded(ranks.percentiles(long, ["feature"], "value", probs, n_groups=2))


# --- files ------------------------------------------------------------------------------------


@register(
    "run_metadata_files",
    """SELECT CAST(page_id AS VARCHAR) AS run_accession, CAST(i AS INTEGER) AS file_no,
CASE i WHEN 1 THEN replace(url, ';', '') || '_1' ELSE replace(url, ';', '') || '_2' END AS file,
CASE i WHEN 1 THEN length(html) ELSE length(url) END AS bytes FROM pages, range(1, 3) t(i)""",
)
def run_metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(F.col("url"), F.lit(";"), F.lit(""))
    runs = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("run_accession"),
        F.concat(url, F.lit("_1;"), url, F.lit("_2")).alias("fastq_ftp"),
        F.concat_ws(";", F.length("html"), F.length("url")).alias("fastq_bytes"),
    )
    return explode_run_files(runs)


@register("arriving_files", "SELECT event_type AS study, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    target, marks = fresh_path(spark, "ingested"), fresh_path(spark, "progress")
    ingest_studies(
        spark, sf_dir, target, marks, schema, fmt="parquet", key="event_id", study="event_type", glob="events.parquet"
    )
    return stats.study_counts(read_ingested(spark, target, schema), "event_type").withColumnRenamed(
        "event_type", "study"
    )


@register(
    "arriving_csv",
    """SELECT event_type AS study, count(DISTINCT event_id) AS n, count(DISTINCT CASE WHEN event_id % 3 <> 2 THEN event_id END) AS n_value,
round(sum(CASE WHEN event_id % 3 <> 2 THEN value END), 2) + 0e0 AS total FROM events GROUP BY event_type""",
)
def arriving_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files with two column orders, and some without the value column, matched by name."""
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    source, target, marks = (fresh_path(spark, x) for x in ("arriving", "ingested", "progress"))
    events = table(spark, sf_dir, "events")
    for rest, columns in enumerate((["event_id", "event_type", "value"], ["value", "event_type", "event_id"], ["event_type", "event_id"])):
        part = events.where(F.pmod("event_id", F.lit(3)) == rest).select(*columns)
        part.write.mode("append").option("header", True).csv(source)
    ingest_studies(spark, source, target, marks, schema, key="event_id", study="event_type", glob="*.csv")
    return (
        read_ingested(spark, target, schema)
        .groupBy(F.col("event_type").alias("study"))
        .agg(F.count("*").alias("n"), F.count("value").alias("n_value"), (F.round(F.sum("value"), 2) + 0.0).alias("total"))
    )


@register(
    "arriving_missing_ids",
    """SELECT event_type AS study, count(DISTINCT CASE WHEN event_id % 3 <> 1 THEN event_id END) + count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS n,
count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS n_without_id FROM events GROUP BY event_type""",
)
def arriving_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows has no identifier; none of these is taken for a copy of another."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    source, target, marks = (fresh_path(spark, x) for x in ("arriving", "ingested", "progress"))
    known = F.when(F.pmod("event_id", F.lit(3)) != 1, F.col("event_id"))
    table(spark, sf_dir, "events").select(known.alias("event_id"), "event_type").write.option("header", True).csv(source)
    ingest_studies(spark, source, target, marks, schema, key="event_id", study="event_type", glob="*.csv")
    rows = read_ingested(spark, target, schema).groupBy(F.col("event_type").alias("study"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_id").isNull()).alias("n_without_id"))
