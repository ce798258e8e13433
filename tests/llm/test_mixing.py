import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from cohortspark.llm import mixing as M
from tests.llm.helpers import UNSPACED


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshares the excess in exact fractions until no target is above its limit."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    full = set()
    while True:
        rest = sum(sizes) - sum(most * sizes[k] for k in full)
        each = sum(x for k, x in enumerate(w) if k not in full)
        target = [Fraction(most * s) if k in full else Fraction(w[k] * rest, each) for k, s in enumerate(sizes)]
        above = {k for k, s in enumerate(sizes) if k not in full and target[k] > most * s}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 0, 7], [0, 0], [5], [1, 1, 1, 1000], [3, 9, 27, 81, 243, 729]])
def test_targets(sizes):
    sources = [M.Source(str(k), s, 1) for k, s in enumerate(sizes)]
    M.set_targets(sources)
    want = plain_targets(sizes)
    assert [s.target for s in sources] == [float(t) for t in want]
    assert sum(want) == sum(sizes)


def test_tree_is_exact_in_both_sums_and_repeats():
    draws = np.array([1000, 0, 37, 5])
    got = M.split_draws(draws, 8, "s")
    assert (got.sum(axis=0) == draws).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 3
    assert (got == M.split_draws(draws, 8, "s")).all() and (got != M.split_draws(draws, 8, "t")).any()


def made():
    rng = random.Random(2)
    text = lambda n: " \t".join(f"w{i}" for i in range(n))
    rows = [(k, text(rng.randint(0, 60)), rng.choice(["a", "B", "é", None])) for k in range(300)]
    rows += [(1000 + k, text(9), "hot") for k in range(400)] + [(2000, text(300), "z"), (2001, None, "z"), (2002, "", "empty"), (2002, "", "empty")]
    return rows


def md5(*parts):
    return hashlib.md5("|".join(["mix", *map(str, parts)]).encode()).hexdigest()


def plain_mix(rows, shards=8):
    """(id, text, size, source's size, target, shards of its draws) of every (id, text, source), by loops over sorted lists."""
    count = lambda t: len(UNSPACED.findall(t or ""))
    by_source = {}
    for k, t, s in rows:
        order = md5("" if k is None else k, "" if t is None else t)
        by_source.setdefault(s, []).append((order, count(t), k, t))
    names = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    sizes = [sum(d[1] for d in by_source[s]) for s in names]
    targets = plain_targets(sizes)
    block = max(1, sum(sizes) // M.BLOCKS)
    quotas = [int(t + Fraction(1, 2)) for t in targets]
    passes = [divmod(q, n) if n else (0, 0) for q, n in zip(quotas, sizes, strict=True)]
    counts = np.array([w * -(-n // block) + -(-x // block) for (w, x), n in zip(passes, sizes, strict=True)])
    ends = np.cumsum(M.split_draws(counts, shards, "mix"), axis=0)
    out = []
    for k, s in enumerate(names):
        start, blocks = 0, {}
        for d in sorted(by_source[s], key=lambda d: d[:2]):
            blocks.setdefault(start // block, []).append(d)
            start += d[1]
        at = 0
        whole, last = passes[k]
        for b in sorted(blocks, key=lambda b: md5(s or "", b)):
            for _, n, doc, t in blocks[b]:
                times = (whole + (abs(last - at - n) <= abs(last - at))) if n else 0
                places = [p * -(-sizes[k] // block) + at // block for p in range(times)]
                out.append((doc, t, n, sizes[k], float(targets[k]), [int((ends[:, k] <= x).sum()) for x in places]))
                at += n
    return out


@pytest.mark.parametrize("bucket_rows,blocks", [(20_000, 1 << 15), (10, 1 << 15), (10, 40)])
def test_taken_words_are_those_of_the_plain_version(spark, bucket_rows, blocks, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(M, "BLOCKS", blocks)
    rows = made()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, _start int")
    got = M.taken(table).collect()
    want = plain_mix(rows)
    assert sorted(map(tuple, got)) == sorted((k, n, size, target, n * len(at)) for k, _, n, size, target, at in want)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    largest, sums = {}, {}
    for k, _, n, size, target, at in want:
        largest[size, target] = max(largest.get((size, target), 0), n)
        sums[size, target] = sums.get((size, target), 0) + n * len(at)
    assert all(abs(sums[k] - k[1]) <= largest[k] / 2 + 1 for k in sums)  # half of the document at the end


@pytest.mark.parametrize("blocks", [1 << 15, 40])
def test_mixed_rows_are_whole_and_go_where_the_tree_says(spark, blocks, monkeypatch):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    table = spark.createDataFrame([(*r, 7) for r in made()], "doc_id long, text string, source string, _size int")
    rows = M.mix(table).collect()
    assert sorted((r["doc_id"], r["text"], r["mix_shard"]) for r in rows) == sorted((k, t, s) for k, t, *_, at in plain_mix(made()) for s in at)
    # Draws are exact; a document goes as a whole where it starts, which leaves the spread of its size and one block.
    sizes = np.array([len(UNSPACED.findall(r["text"])) for r in rows])
    words = np.bincount([r["mix_shard"] for r in rows], weights=sizes, minlength=8)
    assert np.abs(words - words.mean()).max() <= 4 * ((sizes**2).sum() / 8) ** 0.5 + sizes.sum() // blocks * 8
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(table.repartition(5)).collect()))
    assert M.mix(table.limit(0)).count() == 0 and M.taken(table.limit(0)).count() == 0


def test_reruns_agree_without_ids_and_with_repeated_ids(spark):
    rows = [(None if k % 3 else k % 7, f"w{k} " * (1 + k % 5), "ab"[k % 2]) for k in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, M.mix(table.repartition(n)).collect())) for n in (3, 7)]
    assert runs[0] == runs[1]
    assert sorted((str(k), n * len(at)) for k, _, n, *_, at in plain_mix(rows)) == sorted(
        (str(r["doc_id"]), r["taken"]) for r in M.taken(table).collect()
    )
