import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm import toxicity as T
from cohortspark.llm.op10_langid import held_out
from tests.llm.helpers import held_out as plain_held_out
from tests.llm.helpers import words


def risk(f, positive, prior, harmless):
    loss = lambda x: np.log1p(np.exp(-x))
    rest = loss(-f[~positive]).mean() - prior * loss(-f[positive]).mean()
    return prior * loss(f[positive]).mean() + rest if harmless else -rest


def test_gradient_of_the_corrected_risk():
    rng = np.random.default_rng(1)
    for shift, harmless in ((0.0, True), (8.0, False)):
        positive = np.arange(30) < 10
        f = rng.normal(size=30) + np.where(positive, shift, -shift)
        got = T.nnpu_gradient(f, positive, 0.4)
        for k in (0, 5, 12, 29):
            e = np.eye(30)[k] * 1e-6
            assert abs(got[k] - (risk(f + e, positive, 0.4, harmless) - risk(f - e, positive, 0.4, harmless)) / 2e-6) < 1e-6


def test_features_count_distinct_words():
    raw, offsets = T.W.strings(pa.array(["abcdef abcdef abcdxy", None, "Z"], pa.large_string()))
    texts, places, distinct = T.features(T.W.split(raw, offsets))
    assert distinct.tolist() == [2, 0, 1] and len(places) == 3 * (1 + len(T.PREFIXES))
    mine = places[texts == 0].reshape(-1, 2)  # word, then one row for each prefix length
    assert mine[1][0] == mine[1][1] and mine[2][0] != mine[2][1]


def corpus(n=900):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        w = [f"{rng.choice(['ba', 'ko', 'li', 'mu'])}{rng.randint(0, 400)}" for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            w += rng.choices(["nastyone", "viletwo", "awfulthree"], k=max(2, len(w) // 15))
        rng.shuffle(w)
        rows.append((k, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_from_positive_and_unlabelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "q", "x") for k, t, _ in rows], "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(k, 1) for k, _, y in rows if y and k % 2], "doc_id long, toxic int")
    model = T.fit(docs, labels, ~held_out(), prior=0.2)
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    test = [(got[k], y) for k, _, y in rows if plain_held_out(k)]
    right = np.mean([(s >= 0.3) == bool(y) for s, y in test])
    assert right > 0.93
    again = {r["doc_id"]: r["score"] for r in T.score(docs, T.fit(docs, labels, ~held_out(), prior=0.2)).collect()}
    assert again == got
    flipped = labels.unionByName(spark.createDataFrame([(k, 1) for k, _, _ in rows if plain_held_out(k)], labels.schema))
    assert {r["doc_id"]: r["score"] for r in T.score(docs, T.fit(docs, flipped, ~held_out(), prior=0.2)).collect()} == got


def test_scores_are_plain_sums(spark):
    rng = np.random.default_rng(2)
    model = T.Model(rng.normal(size=(2, 1 << T.BITS)).astype(np.float32), np.array([-1.0, 0.5]), 0.3)
    texts = ["one two two", "Three", None, "", "é " * 50]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    for r in T.score(docs, model).collect():
        mine = set(words(texts[r["doc_id"]]))
        if not mine:
            assert r["score"] <= 0.3
            continue
        raw, offsets = T.W.strings(pa.array([" ".join(sorted(mine))], pa.large_string()))
        _, places, _ = T.features(T.W.split(raw, offsets))
        f = [model.weights[m].astype(float)[places].sum() * 3 / (10 + len(mine)) ** 0.5 + model.bias[m] for m in range(2)]
        assert abs(r["score"] - np.mean([1 / (1 + np.exp(-x)) for x in f])) < 1e-9


def test_samples_are_bounded_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "POSITIVES", 20)
    monkeypatch.setattr(T, "UNLABELLED", 30)
    rows = [(None if k % 3 == 0 else 5, f"word {k}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(5, 1), (6, 0)], "_id long, _toxic int")
    sample = T.draw(docs, marks, 1, F.lit(True), "doc_id", "text").groupBy("model", "positive").count().collect()
    assert len(sample) == 2 * T.MODELS
    for r in sample:
        assert r["count"] == 20 * T.SPARE if r["positive"] else 10 <= r["count"] <= 30 * T.SPARE


def test_nothing_known_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in T.score(docs, T.fit(docs, none, F.lit(True))).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    model = T.fit(docs, one, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in T.score(docs, model).collect())
    assert T.score(docs.limit(0), model).count() == 0
    assert len(T.fit(docs.limit(0), one, F.lit(True)).bias) == 0
