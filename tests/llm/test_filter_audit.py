"""The filter audit against counting documents order by order."""

import random
import re
from itertools import permutations

import pytest

from cohortspark.llm import filter_audit as A
from cohortspark.llm.op12_filter_audit import FILTERS, audit, failure_counts, op12_filter_audit
from tests.conftest import SMALL
from tests.llm.helpers import UNSPACED, table

DOCS = "doc_id long, text string, lang string, digest string, mask int, good string, part int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(doc_id, text, ids):
    words = UNSPACED.findall(text)
    yield len(words) < 100
    yield 100 * len(set(words)) < 80 * len(words)
    yield 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)
    yield re.search(r"[#$%&*|]", text) is not None
    yield doc_id is not None and min(ids, default=doc_id) < doc_id


def plain(docs, labels):
    """Every order applied to every document; ``docs`` are (doc_id, text, lang)."""
    ids, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            ids.setdefault(text or "", set()).add(doc_id)
    for doc_id, quality, bad in labels:
        good |= {doc_id} if quality == 1 and doc_id is not None else set()
        toxic |= {doc_id} if bad == 1 and doc_id is not None else set()
    parts = {}
    for doc_id, text, lang in docs:
        failed = {f for f, x in zip(FILTERS, fails(doc_id, text or "", ids.get(text or "", ())), strict=True) if x}
        parts.setdefault(lang or "", []).append((doc_id, failed))
    out, shapley = {}, {}
    for part, rows in parts.items():
        for order in permutations(FILTERS):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f in x for _, x in rows) - len(gone),
                    sum(x == {f} for _, x in rows),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def asked(df):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {tuple(r[:3]): tuple(r[3:]) for r in df.select(*names).collect()}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_reach_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for place in A.adjacent_swaps(n):
        order[place : place + 2] = order[place + 1], order[place]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(permutations(range(n))))


def test_swapped_diagram_is_the_one_built_in_that_order():
    rng = random.Random(5)
    masks = {rng.randrange(32): (rng.randrange(1, 4), rng.randrange(2)) for _ in range(12)}
    d = A.Diagram("ABCDE", masks, 2)
    for place in A.adjacent_swaps(5):
        d.swap(place)
        bits = {m: sum((m >> "ABCDE".index(f) & 1) << k for k, f in enumerate(d.order)) for m in masks}
        fresh = A.Diagram(d.order, {bits[m]: n for m, n in masks.items()}, 2)
        assert list(d.all_pass()) == list(fresh.all_pass()) and d.failing() == fresh.failing()
        assert d.weight(d.top) == fresh.weight(fresh.top)


def test_equal_subgraphs_are_shared():
    masks = {m: (3,) for m in range(32)}
    assert len(A.Diagram("ABCDE", masks, 1).nodes) == 6


def test_nulls_repeats_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["AB", "X|", "\x0b", "é#"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 99, 100, 130, 400]))) for _ in range(40)] + [None, "", " \n"]
    docs = []
    for _ in range(300):
        doc_id = None if rng.random() < 0.3 else rng.randrange(120)
        docs.append((doc_id, rng.choice(texts), rng.choice(["a", "b", "", None])))
    docs += [docs[0]] * 5 + [(7, "big " * 200_000, "c")]
    labels = [(rng.randrange(140), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], DOCS).repartition(5)
    counts = failure_counts(frame, spark.createDataFrame([(*r, "z") for r in labels], LABELS))
    assert asked(audit(counts, FILTERS, ["good", "toxic"])) == plain(docs, labels)


def test_empty_tables(spark):
    counts = failure_counts(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert audit(counts, FILTERS, ["good", "toxic"]).count() == 0


def test_query_as_the_plain_version(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, "documents").collect()]
    labels = [tuple(r) for r in table(spark, "labels").select("doc_id", "quality", "toxic").collect()]
    assert asked(op12_filter_audit(spark, SMALL)) == plain(docs, labels)
