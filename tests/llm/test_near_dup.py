import random
from statistics import mean, pvariance

import numpy as np
import pytest

from cohortspark.llm import near_dup as N
from cohortspark.llm import superminhash as S
from tests.llm.helpers import unspaced

SCHEMA = "doc_id long, text string, n_shingles string, key int"


def shingles(text):
    w = unspaced(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(docs):
    """component id by id, from all pairs."""
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in ids}


def made(seed, copies=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    docs = []
    passage = [word() for _ in range(40)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(8, 80))]
        for _ in range(rng.randint(1, copies)):
            docs.append(" ".join(word() if rng.random() < rng.choice((0, 0.01, 0.04, 0.1)) else w for w in base))
    docs += [" ".join(passage + [word() for _ in range(rng.randint(5, 40))]) for _ in range(30)]
    docs += [None, "", "  \t", "one", "one", "One two three four", "one two three four", "é é é é é é"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "tile", "most"), [(1, 2048, 4), (2, 4, 100), (3, 4, 2)])
def test_components_are_those_of_all_pairs(spark, seed, tile, most, monkeypatch):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "MAX_TILES", most)
    docs = made(seed)
    table = spark.createDataFrame([(k, t, "x", 0) for k, t in docs], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(table).collect()}
    assert got == plain(docs)
    kept = N.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_pairs_that_share_one_band_are_found_in_buckets_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "MAX_TILES", 2)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**16, (2, S.SLOTS), dtype=np.uint16)
    used = S.BANDS * S.ROWS
    b[:] = a
    b[S.ROWS : used : S.ROWS] ^= 1  # every band but the first differs in one slot
    rest = rng.integers(0, 2**16, (40, S.SLOTS), dtype=np.uint16)
    table = [(0, 1, 42, bytes([k]), bytes([min(k, 12)]), p.tobytes()) for k, p in enumerate([a, *rest, b])]
    table[-1] = (*table[-1][:4], b"z", table[-1][5])  # 29 members are one group, the others are groups of one
    rows = spark.createDataFrame(table, "band int, bucket long, n long, key binary, label binary, prints binary")
    divided = N.divided(rows.drop("prints"), rows.select("key", "prints"))
    got = N.candidates(divided, N.SHARE).collect()
    assert {bytes(r["key"]) for r in got} == {bytes([0]), bytes([41])}
    # Every pair of different groups meets once; pairs of tiles of one group are left out.
    met = {}
    for r in divided.collect():
        met.setdefault((r["i"], r["j"]), []).append((r["tile"], bytes(r["key"]), bytes(r["label"])))
    for (i, j), members in met.items():
        assert len({m[2] for m in members}) > 1 and {m[0] for m in members} == {i, j}
    pairs = [
        frozenset((p[1], q[1])) for (i, j), ms in met.items() for p in ms for q in ms
        if p[1] < q[1] and p[2] != q[2] and {p[0], q[0]} == {i, j}
    ]
    label = {t[3]: t[4] for t in table}
    assert sorted(map(sorted, pairs)) == sorted([x, y] for x in label for y in label if x < y and label[x] != label[y])


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (2, None), (2, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(table).collect()), key=str)
    assert got == sorted(
        [(1, 4, 1, True)] * 2 + [(None, 4, 1, False), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, True)], key=str
    )
    assert N.near_duplicates(table.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    long = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, long("a"), 1), (None, long("a"), 2), (None, long("b"), 3), (None, long("c"), 4),  # null ids with texts of their own
        (2, long("d"), 5), (3, long("d"), 6), (3, long("e"), 7), (4, long("e", 39), 8),  # an id on two texts, each in a group
        (5, long("f"), 9), (5, long("f"), 9), (5, long("f"), 10),  # repeated rows
        (None, long("g"), 11), (None, long("g", 39), 12), (None, long("g").upper(), 13),  # a group of null ids only
        (None, None, 14), (6, "", 15), (6, "", 15),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for docs in (table, table.repartition(3, "n")):
        kept = N.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted(r["n"] for r in kept.collect())
        assert [x for x in got if x not in (9, 10, 11, 12, 13)] == [1, 3, 4, 5, 7, 14, 15, 15]
        assert sum(x in (9, 10) for x in got) == 1 and sum(x in (11, 12, 13) for x in got) == 1
    assert N.keep_one(table.limit(0)).count() == 0


def test_sets_of_null_ids_only_are_linked(spark):
    long = " ".join(f"w{i}" for i in range(40))
    table = spark.createDataFrame([(None, long), (None, long + " x"), (7, long + " y"), (8, "of its own")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in N.near_duplicates(table).collect()), key=str)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (8, 8)], key=str)


def test_estimates_are_unbiased_and_vary_less_than_independent_ranks():
    rng = np.random.default_rng(1)
    for shared, own in ((60, 20), (30, 50)):
        truth = shared / (shared + 2 * own)
        estimates = []
        for _ in range(300):
            x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            sets = [np.sort(x[: shared + own]), np.sort(np.concatenate([x[:shared], x[shared + own :]]))]
            sig = S.signatures(np.concatenate(sets), np.array([0, shared + own, 2 * (shared + own)]))
            estimates.append((sig[0] == sig[1]).mean())
        assert abs(mean(estimates) - truth) < 4 * (truth * (1 - truth) / S.SLOTS / 300) ** 0.5
        assert pvariance(estimates) < 0.95 * truth * (1 - truth) / S.SLOTS


def test_signature_is_the_smallest_rank_of_every_slot():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 400]
    x = [np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in sizes]
    sig = S.signatures(np.concatenate(x), np.concatenate([[0], np.cumsum(sizes)]))
    assert (sig != np.uint64(2**64 - 1)).all()
    for k, elements in enumerate(x):
        alone = [S.signatures(elements[i : i + 1], np.array([0, 1]))[0] for i in range(len(elements))]
        assert (np.min(alone, axis=0) == sig[k]).all()
