import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import sharding as S


def plain_pack(items, shards):
    left = [[1 / shards] * len(items[0]) for _ in range(shards)]
    out = [0] * len(items)
    for k in sorted(range(len(items)), key=lambda k: (-max(items[k]), -sum(items[k]), k)):
        dots = [sum(a * b for a, b in zip(items[k], r, strict=True)) for r in left]
        best = dots.index(max(dots))
        out[k] = best
        left[best] = [a - b for a, b in zip(left[best], items[k], strict=True)]
    return out


def test_packing_is_that_of_a_plain_loop():
    rng = np.random.default_rng(5)
    for shards in (1, 3, 8):
        items = rng.integers(1, 64, (200, 3)) / 4096
        assert S.pack(items, shards).tolist() == plain_pack(items.tolist(), shards)
    assert S.pack(np.zeros((0, 3)), 4).tolist() == []


@pytest.mark.parametrize("slot_rows", [20_000, 7])
def test_shards_balance_and_slots_have_no_gaps(spark, slot_rows, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", slot_rows)
    rng = random.Random(1)
    texts = [" ".join("ab" * rng.randint(1, 5) for _ in range(rng.randint(1, 40))) for _ in range(700)]
    texts += ["the same text again"] * 350 + [None, "", "", "é"]  # a third of all rows share one text
    rows = [(k, t, k % 5, "x") for k, t in enumerate(texts)] + [(3, texts[3], 3, "x")] * 4
    table = spark.createDataFrame(rows, "doc_id long, text string, _shard long, slot0 string")
    got = S.shard_documents(table).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((k, t or "") for k, t, _, _ in rows)
    size = lambda t: len((t or "").encode()) + 1
    total, most = sum(size(r["text"]) for r in got), max(size(r["text"]) for r in got)
    groups = {}
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(size(r["text"]) for r in mine) - total / 8) <= most
        assert abs(len(mine) - len(rows) / 8) < 0.15 * len(rows) / 8
        for r in mine:
            groups.setdefault(r["text"] or "", set()).add(s)
    assert all(len(v) == 1 for t, v in groups.items() if t != "the same text again")
    assert len(groups["the same text again"]) == 8
    assert sorted(map(str, S.shard_documents(table).collect())) == sorted(map(str, got))


def test_slots_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    table = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string")
    want = sorted(map(tuple, S.shard_documents(table).collect()))
    monkeypatch.setattr(S, "SLOT_ROWS", 5)
    assert sorted(map(tuple, S.shard_documents(table).collect())) == want


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", 25)
    rows = [(None if k % 3 == 0 else k, f"text {k}") for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard_documents(table).collect()
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        slots = sorted(r["slot"] for r in mine if r["doc_id"] is None)
        assert slots[-1] - slots[0] > 0.8 * len(mine) and np.diff(slots).max() < 0.1 * len(mine)
    again = S.shard_documents(table.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_columns_of_the_query(spark):
    assert zlib.crc32("é".encode()) == spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0]


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
