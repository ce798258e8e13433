import duckdb

from __spark_entry__ import oracle_sql
from cohortspark.llm import licenses as L
from cohortspark.llm.op06_licenses import op6_licenses
from tests.llm.helpers import words

TEXTS = [
    None, "", "nothing here", "All rights reserved. all RIGHTS reserved", "cc by cc by", "CC BY-NC 4.0", "by cc",
    "x Licensed under the Apache License, Version 2.0. y", "Apache License, Version 2.0", "the apache license version 3 0",
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "general public license general public license", "a " * 30 + L.TEMPLATES[4].text + " b", L.TEMPLATES[4].text[:60],
    "public license", " ".join(t.text for t in L.TEMPLATES),
]


def plain(text):
    w = words(text)
    base = sorted((label, i) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    found = set()
    for template in L.TEMPLATES:
        v = template.words()
        for s in range(-len(v), len(w)):
            at = lambda i: w[s + i] if 0 <= s + i < len(w) else None  # noqa: B023,E731
            keys = all([at(o + i) for i in range(len(k))] == k for o, k in template.key_places())
            if keys:
                found.add((template.label, s, sum(at(i) == x for i, x in enumerate(v)) / len(v)))
    return len(w), base, sorted(found)


def test_scan_agrees_with_every_start(spark):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words string, base int")
    rows = L.scan(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        got = (r["n_words"], sorted(map(tuple, r["base"])), sorted(set(map(tuple, r["found"]))))
        assert got == plain(TEXTS[r["doc_id"] % len(TEXTS)])


def test_key_phrases_suffice_whatever_the_corpus(spark):
    """A notice that has the key phrases alone, in a corpus without the template's other words."""
    text = "this file is subject to the terms of the Mozilla Public License"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "x " + text)], "doc_id long, text string")
    got = {r["doc_id"]: [(x["label"], x["start"]) for x in r["found"]] for r in L.scan(docs).collect()}
    start = 3 - L.TEMPLATES[10].key_places()[0][0]
    assert got == {1: [("mpl-2.0", start)], 2: [], 3: [("mpl-2.0", start + 1)]}


def test_sql_states_the_same_rule(spark, tmp_path):
    """Key phrases alone, whole notices, and words out of place."""
    texts = [*TEXTS, "this file is subject to the terms of the Mozilla Public License", *(k for t in L.TEMPLATES for k in t.keys)]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    answer = con.execute(oracle_sql()["op6_licenses"])
    names = [d[0] for d in answer.description]
    want = sorted(answer.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want
    assert any(r[names.index("labels")] == "mpl-2.0" for r in want)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert L.scan(docs.limit(0)).count() == 0
