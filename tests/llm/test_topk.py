import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql as sql
from cohortspark.llm import topk as K


def plain(rows, k):
    """Every row against every row but itself."""
    kept = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(kept):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(kept) if b != a and len(c) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_lists_are_those_of_all_pairs(spark, small, monkeypatch):
    if small:  # many tiles, several merges
        for name, value in (("QUERY_BLOCK", 3), ("SHARD", 20), ("FAN", 2), ("STRIP", 2)):
            monkeypatch.setattr(K, name, value)
    rng = random.Random(3)
    vectors = [(i, [rng.choice((-1.5, -0.01, 0.0, 0.25, 1.0)) for _ in range(4)]) for i in range(0, 240, 2)]
    vectors += [(i, [0.25, 0.25, 1.0, 0.0]) for i in range(1, 60, 2)]  # one very common vector, many ties
    vectors += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [1.0, math.inf, 0.0, 0.0]), (304, [math.nan] * 4)]
    vectors += [(320, [1.0, 2.0]), (321, [2.0, 1.0]), (40, [0.0, 0.0, 0.0, 9.0]), (40, [0.0, 0.0, 0.0, 9.0]), (60, [1.0] * 4), (61, [1.0] * 4), (61, [1.0] * 4), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, id int")
    got = K.top_k(table, F.col("id") % 20 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == plain(vectors, 5)


def test_large_components_are_exact(spark):
    rows = [(20, [1e6 + 0.3, 3e7]), (1, [2.5e7, 1e6]), (2, [2.5e7 + 1, 1e6])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.top_k(table, F.col("id") % 20 == 0, k=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, 2)


def test_scores_beyond_64_bits_saturate(spark):
    rows = [(20, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0]), (4, [1e308, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in K.top_k(table, F.col("id") % 20 == 0, k=9).collect()}
    assert got == {1: 2**63 - 1, 3: 0, 2: -(2**63)}


def test_a_third_of_the_rows_has_one_id(spark, monkeypatch):
    """Copies beyond k, different vectors under one id, clashing column names; the SQL says the same."""
    monkeypatch.setattr(K, "COPIES", 4)
    rng = random.Random(7)
    vectors = [(20, [1.0, 0.0])] * 30 + [(20, [float(rng.randint(-3, 3)), 0.5]) for _ in range(30)]
    vectors += [(i, [float(rng.randint(-3, 3)), 1.0]) for i in range(100, 220)]
    table = spark.createDataFrame([(*v, "x", 1, 2) for v in vectors], "vec_id long, embedding array<double>, key string, copies int, block int")
    got = sorted(map(tuple, K.top_k(table, F.col("id") % 20 == 0, k=20).collect()))
    assert got == plain(vectors, 20)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", vectors)
    assert sorted(con.execute(sql()["op2_topk"]).fetchall()) == sorted((q, r, v, s) for q, r, v, s in got)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(table, F.col("id") % 20 == 0).count() == 0
