"""Periodic runs against testing every stretch of words."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import periodic as P
from cohortspark.llm.op11_runs import op11_runs, planted
from tests.conftest import SMALL
from tests.llm.helpers import UNSPACED, table

DOCS = "doc_id long, text string, id string, period int, task int, runs string"


def plain_runs(words):
    """Maximal stretches by the definition, one period after the other."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(12, 2 * p):
                part = words[start : start + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted_words(doc_id, text):
    words = UNSPACED.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def some_words(rng):
    """Few or many letters, with periodic and nearly periodic parts."""
    letters = "ab" if rng.random() < 0.4 else "abcdefghijklmnop"
    words = []
    for _ in range(rng.randrange(1, 6)):
        unit = rng.choices(letters, k=rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70]))
        part = (unit * 40)[: rng.randrange(1, 5 * len(unit) + 14)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "x"
        words += part + rng.choices(letters, k=rng.randrange(20))
    return words


def hard_words(seed):
    """Nested repetitions."""
    fibonacci, other = ["a", "b"], ["a"]
    while len(fibonacci) < 300 + seed:
        fibonacci, other = fibonacci + other, fibonacci
    thue = [str(bin(k).count("1") % 2) for k in range(400)]
    return [fibonacci, thue, ["w"] * 300, (["a"] * 7 + ["b"]) * 30 + (["a"] * 8 + ["b"]) * 30, thue[:37] * 9]


def found(docs, spark):
    frame = spark.createDataFrame([(k, " ".join(w), "z", 1, 2, "q") for k, w in docs], DOCS)
    return {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in P.find_runs(frame).collect()}


def test_spaces_fit_the_shortest_runs():
    for k in range(20):
        size = 1 << k
        assert P.spacing(size) <= P.least_matches(size) <= P.reach(size)
        assert (P.WINDOW if size <= 8 else size // 2) <= P.least_matches(size)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = rng.choices([0, 1], k=rng.randrange(1, 30))
        z = P.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_runs_of_many_texts(spark):
    rng = random.Random(11)
    docs = [some_words(rng) for _ in range(400)] + hard_words(16)
    got = found(list(enumerate(docs)), spark)
    for k, words in enumerate(docs):
        runs = plain_runs(words)
        assert got[k] == (runs, plain_collapsed(words, runs), len(words)), k


@pytest.mark.parametrize("coarse", [False, True])
def test_tiles_of_any_size_give_whole_stretches(monkeypatch, coarse):
    """Boundaries solved apart give the stretches of the whole text; equal hashes of unequal windows only add tiles."""
    monkeypatch.setattr(P, "TILE", 16)
    if coarse:
        monkeypatch.setattr(P.W, "mix", lambda x: x & np.uint64(3))
    rng = random.Random(9)
    for words in [some_words(rng) for _ in range(60)] + hard_words(3):
        ids = np.unique(words, return_inverse=True)[1].astype(np.int32)
        seen = {}
        for _, size, boundaries, low, part in P.tiles(ids, np.array([0, len(ids)])):
            for b in boundaries:
                for p, start, end in P.solve(size, [b], low, part):
                    seen.setdefault(p, set()).update(range(start, end))
        want = {}
        for start, length, p in plain_runs(ids.tolist()):
            want.setdefault(p, set()).update(range(start, start + length - p))
        assert seen == want


def test_nulls_repeats_blanks_and_long_texts(spark):
    long = ["u", "v", "w"] * 20_000 + [str(k) for k in range(30_000)] * 2
    rows = [(None, None), (None, ""), (None, " \n\t"), (None, "a " * 12), (4, "a " * 12), (4, "a " * 12), (5, " ".join(long))]
    frame = spark.createDataFrame([(*r, "z", 1, 2, "q") for r in rows], DOCS)
    got = P.find_runs(frame).collect()
    assert sorted((r.n_words, len(r.runs), r.collapsed) for r in got if r.doc_id is None) == [
        (0, 0, ""),
        (0, 0, ""),
        (0, 0, ""),
        (12, 1, "a"),
    ]
    assert [(tuple(r.runs[0]), r.collapsed) for r in got if r.doc_id == 4] == [((0, 12, 1), "a")] * 2
    (last,) = [r for r in got if r.doc_id == 5]
    assert [tuple(x) for x in last.runs] == [(0, 60_000, 3), (60_000, 60_000, 30_000)]
    assert last.collapsed == " ".join(long[:3] + long[60_000:90_000])
    assert P.find_runs(frame.limit(0)).count() == 0


def test_planted_texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(60))) + rng.choice(["", " \n"])) for k in range(400)]
    rows += [(None, "a  b"), (7, None), (10**12, "\tx y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in frame.select("doc_id", planted().alias("text"), frame.text.alias("before")).collect():
        assert UNSPACED.findall(r.text or "") == planted_words(r.doc_id, r.before)


def test_query_as_the_plain_version(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in table(spark, "documents").collect():
        words = planted_words(r.doc_id, r.text)
        if len(words) > 3000:
            continue
        runs = plain_runs(words)
        start, length, p = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        milli = None if p is None else 1000 * length // p
        want[r.doc_id] = (len(runs), start, length, p, milli, sha(lines), sha(plain_collapsed(words, runs)))
    columns = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = {r.doc_id: tuple(r[c] for c in columns) for r in op11_runs(spark, SMALL).collect()}
    assert len(got) == table(spark, "documents").count()
    assert {k: got[k] for k in want} == want
