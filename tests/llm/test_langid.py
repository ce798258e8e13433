import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.llm import langid as L
from cohortspark.llm.op10_langid import held_out, op10_langid
from tests.conftest import SMALL
from tests.llm.helpers import held_out as plain_held_out


def phrases(text, sample):
    """Greedy longest phrases that occur in the sample, in pieces."""
    data = L.plain(np.frombuffer(text.encode(), dtype=np.uint8)).tobytes()
    n = 0
    for a in range(0, len(data), L.PIECE):
        piece = data[a : a + L.PIECE]
        at = 0
        while at < len(piece):
            end = at + 1
            while end < len(piece) and piece[at : end + 1] in sample:
                end += 1
            n, at = n + 1, end
    return n


@given(st.text(alphabet="abc é", min_size=1, max_size=60), st.lists(st.text(alphabet="abcd É!", max_size=600), max_size=4))
@settings(max_examples=80, deadline=None)
def test_phrases_are_those_of_a_plain_parser(sample, texts):
    data = L.plain(np.frombuffer(sample.encode(), dtype=np.uint8)).tobytes()
    parser = L.Parser({"x": data, "y": b"zz"})
    raw, offsets = L.W.strings(pa.array(texts, pa.large_string()))
    got = parser.phrases(raw, offsets)
    assert got[:, 0].tolist() == [phrases(t, data) for t in texts]
    assert got[:, 1].tolist() == [phrases(t, b"zz") for t in texts]


@given(st.text(alphabet="abc", max_size=25))
@settings(max_examples=60, deadline=None)
def test_automaton_accepts_the_substrings_and_nothing_else(text):
    go = L.suffix_automaton(text.encode())
    parts = {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
    for word in parts | {a + b for a in parts for b in "abc" if len(a) < 6}:
        state = 0
        for c in word.encode():
            state = go[state].get(c, -1)
            if state < 0:
                break
        assert (state >= 0) == (word in parts)


def test_held_out_accuracy_and_range(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = op10_langid(spark, SMALL).join(docs, "doc_id").collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {r["doc_id"]: plain_held_out(r["doc_id"]) for r in rows}
    test = [r for r in rows if r["held_out"]]
    assert len(test) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_do_not_read_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    changed = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = L.identify(docs, L.fit(docs, ~held_out())).collect()
    b = L.identify(changed, L.fit(changed, ~held_out())).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("text", [None, "", "  ", "123 !?", "@@@"])
def test_no_letter_is_unknown(spark, text):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(7, text, "q"), (8, "the dog", "q"), (8, "the dog", "q")], "doc_id long, text string, score string")
    parser = L.fit(train, F.lit(True))
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(docs, parser).collect())
    assert got[0] == (7, "und", 0.0) and got[1] == got[2] and got[1][1] == "en"
    assert [r["doc_id"] for r in L.keep_identified(docs, parser).collect()] == [8, 8]


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(docs, F.lit(True)) is None
    assert L.identify(docs, None).first()["lang_pred"] == "und"
    parser = L.Parser({"en": b"abc"})
    assert L.identify(docs.limit(0), parser).count() == 0
    assert L.identify(docs, parser).first()["score"] == 1.0
