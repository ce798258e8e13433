import random

import numpy as np
import pytest

from cohortspark.llm import decontaminate as D
from tests.llm.helpers import words

SCHEMA = "doc_id long, text string, n_words string, items int"  # columns that clash with those of the result


def plain(docs, bench, window):
    """(n_words, hit words, item names) of every document, by trying every place."""
    out = []
    for text in docs:
        w = words(text)
        hit, items = set(), set()
        for name, item in bench:
            v = words(item)
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[i : i + n]:
                        hit.update(range(p, p + n))
                        items.add(str(name) if name is not None else "")
        out.append((len(w), len(hit), sorted(items)))
    return out


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "d", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(k, text(rng.randint(0, 14))) for k in range(6)] + [(1, text(5)), (None, text(4)), (9, None), (10, "  ")]
    docs = [text(rng.randint(0, 60)) for _ in range(12)] + [None, "", "a", bench[0][1], bench[0][1]]
    return docs, bench


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_agree_with_every_place(spark, seed, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 64)
    docs, bench = made(seed)
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(docs)], SCHEMA)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.find_matches(table, items, window=4).collect()}
    for k, (n, hit, names) in enumerate(plain(docs, bench, 4)):
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) == (n, hit, names)
        assert sum(s["end"] - s["start"] for s in got[k]["spans"]) == hit
    kept = D.remove_affected(table, items, window=4)
    assert kept.schema == table.schema
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["n_hit"]}


def test_blocks_give_the_result_of_one(spark):
    docs, bench = made(5)
    table = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    blocks = D.item_blocks(items, "item_id", "text", 4, block_bytes=20)
    assert len(blocks) > 1
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], names=["text"])
    (_, out), = D.batches([batch], 0, blocks)
    assert [(n, h, i) for n, h, i in zip(out["n_words"], out["n_hit"], out["items"], strict=True)] == plain(docs, bench, 4)
    assert table.count() == len(docs)


def test_longest_match_goes_beyond_the_window(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "before " + " ".join(f"w{i}" for i in range(5, 25)) + " after"
    table = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    row = D.find_matches(table, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row["longest"], row["longest_item"], row["longest_start"], row["n_hit"]) == (20, "7", 1, 20)


def test_false_hash_is_found_by_its_bytes(monkeypatch):
    """Two words forced to one hash: the one that is not in the benchmark must not be hit."""
    real = D.W.Words.hashes

    def forced(self, first=None):
        h = real(self, first)
        for i in range(len(self)):
            if self.word(i) in (b"good", b"evil"):
                h[i] = np.uint64(12345)
        return h

    monkeypatch.setattr(D.W.Words, "hashes", forced)
    block = D.make_block(["1"], ["good a b"], 10)
    raw, offsets = D.W.strings(D.pa.array(["evil a b", "x good a b y"]))
    hit, texts, _, _ = D.match_shard(D.W.split(raw, offsets), block)
    assert hit.tolist() == [False] * 3 + [False, True, True, True, False] and texts.tolist() == [1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_matches(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_matches(some, bench).first()["n_hit"] == 0
    assert D.remove_affected(some, bench).count() == 1
