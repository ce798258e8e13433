"""Benchmark decontamination by suffix arrays of the training text.

Every task sorts the suffixes of its own documents (one shard: the words of about four megabytes of text) and looks up
every suffix of every benchmark item by binary search: one bisection for each further word, until no training suffix
agrees any more. That gives the longest verbatim match of each item suffix, and all places where its first ``window``
words stand. Documents are never shuffled. The benchmark travels in blocks of bounded size, each broadcast by itself
and read one after the other by a task, so its total size is free.

Words are compared as 64-bit hashes; a hit is confirmed on the bytes, and a word with a false hash is set apart and the
shard searched again.

Defined results: null and empty texts have no words; an item without words has no window; an item with fewer than
``window`` words is one window; repeated item ids are one item with several texts; a null item id counts as the empty
string; repeated documents each get the same row. Other columns of either table are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import words as W

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20

MATCH_SCHEMA = (
    "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, "
    "longest long, longest_item string, longest_start long"
)


@dataclass
class Block:
    """Suffixes of a block of items, as numbers of a block vocabulary (0: no word, or past the item's end)."""

    names: list[str]
    vocabulary: np.ndarray  # sorted hashes; word number is place + 1
    spelled: list[bytes]
    sifter: np.ndarray  # by the leading bits of a hash: is there such a word?
    flat: np.ndarray  # word numbers of all items, each item closed by a 0
    suffix: np.ndarray  # where each suffix begins in flat
    item: np.ndarray  # item text of each suffix
    name: np.ndarray  # item name of each suffix
    need: np.ndarray  # words its window has; 0: no window begins here
    depth: int


def make_block(ids: list[str], texts: list[str | None], window: int) -> Block:
    raw, offsets = W.strings(pa.array(texts, type=pa.large_string()))
    found = W.split(raw, offsets)
    hashes = found.hashes()
    vocabulary, where = np.unique(hashes, return_index=True)
    number = np.searchsorted(vocabulary, hashes) + 1
    sizes = np.diff(found.text_start)
    names, name_of = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True)
    flat = np.zeros(len(number) + len(sizes), dtype=np.int64)
    item = np.repeat(np.arange(len(sizes)), sizes)
    suffix = np.arange(len(number)) + item
    flat[suffix] = number
    left = np.repeat(found.text_start[1:], sizes) - np.arange(len(number))
    whole = np.repeat(sizes, sizes)
    first = np.arange(len(number)) == np.repeat(found.text_start[:-1], sizes)
    need = np.where(left >= window, window, np.where(first & (whole < window), whole, 0))
    sifter = np.zeros(1 << FILTER_BITS, dtype=bool)
    sifter[(vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Block(
        list(names), vocabulary, [found.word(i) for i in where], sifter, flat, suffix, item, name_of[item], need,
        int(sizes.max(initial=0)),
    )


def item_blocks(bench: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast variables of item blocks. Each holds about ``block_bytes`` of text, whatever the table's size."""
    spark = bench.sparkSession
    rows = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    rows = rows.where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    out = []
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toArrow() if n > 1 else rows.toArrow()
        got = got.sort_by([("i", "ascending"), ("t", "ascending")])
        block = make_block(got["i"].to_pylist(), got["t"].to_pylist(), window)
        if block.need.any():
            out.append(spark.sparkContext.broadcast(block))
    return out


def suffix_array(number: np.ndarray, depth: int) -> np.ndarray:
    """Places with a word number, ordered by their next ``depth`` words (up to the first 0), by prefix doubling.

    Only runs that are still tied are sorted again.
    """
    n = len(number)
    place = np.flatnonzero(number)
    place = place[np.argsort(number[place], kind="stable")]
    rank = np.zeros(n + 1, dtype=np.int64)
    key = number[place]
    head = np.ones(len(place), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
    rank[place] = first + 1
    k = 1
    while k < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        sub = place[at]
        key = rank[sub] * (n + 2) + rank[np.minimum(sub + k, n)]
        order = np.argsort(key, kind="stable")
        place[at], key = sub[order], key[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        first = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
        rank[place[at]] = first[at] + 1
        k *= 2
    return place


def bisect(keys: Callable[[np.ndarray], np.ndarray], want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each entry the first place in [lo, hi) whose key is not below (``right``: above) ``want``."""
    lo, hi = lo.copy(), hi.copy()
    act = np.flatnonzero(lo < hi)
    while len(act):
        mid = (lo[act] + hi[act]) >> 1
        key = keys(mid)
        up = key <= want[act] if right else key < want[act]
        lo[act[up]] = mid[up] + 1
        hi[act[~up]] = mid[~up]
        act = act[lo[act] < hi[act]]
    return lo


def search(place: np.ndarray, number: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each item suffix: [lo, hi) of the training suffixes that begin with its window (empty without one), the
    length of its longest match and one training place that has it."""
    padded = np.concatenate([number, np.zeros(block.depth + 1, dtype=np.int64)])
    m = len(block.suffix)
    lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(place), dtype=np.int64)
    win_lo, win_hi = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    longest, at = np.zeros(m, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    act = np.arange(m)
    d = 0
    while len(act):
        want = block.flat[block.suffix[act] + d]
        live = want > 0
        act, want = act[live], want[live]
        keys = lambda x, d=d: padded[place[x] + d]
        left = bisect(keys, want, lo[act], hi[act], right=False)
        right = bisect(keys, want, left, hi[act], right=True)
        keep = left < right
        act, left, right = act[keep], left[keep], right[keep]
        lo[act], hi[act] = left, right
        d += 1
        longest[act], at[act] = d, place[left] if len(act) else at[act]
        full = block.need[act] == d
        win_lo[act[full]], win_hi[act[full]] = left[full], right[full]
    return win_lo, win_hi, longest, at, np.flatnonzero(win_lo < win_hi)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start and size."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def numbered(hashes: np.ndarray, block: Block) -> np.ndarray:
    number = np.zeros(len(hashes), dtype=np.int64)
    maybe = np.flatnonzero(block.sifter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    at = np.searchsorted(block.vocabulary, hashes[maybe])
    at[at == len(block.vocabulary)] = 0
    same = block.vocabulary[at] == hashes[maybe]
    number[maybe[same]] = at[same] + 1
    return number


def match_shard(found: W.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[int, int, int]]]:
    """Hit words (flags), (text, item name) pairs, and for each text its longest match: words, item name, start."""
    n, n_texts = len(found), len(found.text_start) - 1
    none = np.zeros(0, dtype=np.int64)
    if n == 0:
        return np.zeros(0, dtype=bool), none, none, {}
    text_of = found.text_of()
    flat = numbered(found.hashes(), block)
    # One unused number follows each text, so no match crosses into the next one.
    where = np.arange(n) + text_of
    while True:
        number = np.zeros(n + n_texts, dtype=np.int64)
        number[where] = flat
        place = suffix_array(number, block.depth)
        lo, hi, longest, at, reached = search(place, number, block)
        if len(reached) == 0:
            return np.zeros(n, dtype=bool), none, none, {}
        # A short item and a longer window may stand at the same places: the longer one marks the words.
        reached = reached[np.argsort(-block.need[reached], kind="stable")]
        key = lo[reached] * (len(place) + 1) + hi[reached]
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        one = reached[one]
        sizes = hi[one] - lo[one]
        hits = place[spread(lo[one], sizes)]
        marks = np.zeros(len(number) + 1, dtype=np.int64)
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + np.repeat(block.need[one], sizes), -1)
        hit = (np.cumsum(marks[:-1]) > 0)[where]
        wrong = [i for i in np.flatnonzero(hit) if found.word(i) != block.spelled[flat[i] - 1]]
        if not wrong:
            break
        flat[wrong] = 0
    text_at = np.zeros(len(number), dtype=np.int64)
    text_at[where] = text_of
    # Texts of each group of equal windows, joined with the item names of that group.
    pairs = np.unique(np.repeat(np.arange(len(one)), sizes) * n_texts + text_at[hits])
    texts, groups = pairs % n_texts, pairs // n_texts
    named = np.unique(group * len(block.names) + block.name[reached])
    named_group, named_item = named // len(block.names), named % len(block.names)
    first = np.searchsorted(named_group, np.arange(len(one)))
    many = np.diff(np.append(first, len(named)))[groups]
    both = np.unique(np.repeat(texts, many) * len(block.names) + named_item[spread(first[groups], many)])
    best: dict[int, tuple[int, int, int]] = {}
    for s in reached[np.argsort(-longest[reached], kind="stable")]:
        t = int(text_at[at[s]])
        if t not in best:
            best[t] = (int(longest[s]), int(block.name[s]), int(at[s] - t - found.text_start[t]))
    return hit, both // len(block.names), both % len(block.names), best


def batches(data: Iterable[pa.RecordBatch], column: int, blocks: list) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Each batch with its results by column."""
    for batch in data:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans", "longest", "longest_item", "longest_start")}
        for a, b, raw, offsets in W.chunks(batch.column(column), SHARD_BYTES):
            found = W.split(raw, offsets)
            n = b - a
            hit = np.zeros(len(found), dtype=bool)
            items: dict[int, set[str]] = {}
            best: dict[int, tuple[int, str, int]] = {}
            for shared in blocks:
                block = shared.value
                some, texts, names, longest = match_shard(found, block)
                hit |= some
                for t, k in zip(texts.tolist(), names.tolist(), strict=True):
                    items.setdefault(t, set()).add(block.names[k])
                for t, (size, k, start) in longest.items():
                    if t not in best or (-size, block.names[k]) < (-best[t][0], best[t][1]):
                        best[t] = (size, block.names[k], start)
            out["n_words"] += np.diff(found.text_start).tolist()
            total = np.concatenate([[0], np.cumsum(hit)])
            out["n_hit"] += np.diff(total[found.text_start]).tolist()
            out["items"] += [sorted(items[t]) if t in items else [] for t in range(n)]
            out["spans"] += [runs(hit[found.text_start[t] : found.text_start[t + 1]]) if t in items else [] for t in range(n)]
            for k, name in enumerate(("longest", "longest_item", "longest_start")):
                out[name] += [best[t][k] if t in best else (0 if k == 0 else None) for t in range(n)]
        yield batch, out


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)]


MATCH_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("longest", pa.int64()),
        ("longest_item", pa.string()),
        ("longest_start", pa.int64()),
    ]
)


def find_matches(
    docs: DataFrame,
    bench: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: its id, words, hit words, items found, hit spans (in words) and the longest match."""
    blocks = item_blocks(bench, item_id, item_text, window)
    slim = docs.select(F.col(doc_id), F.col(text))
    id_type = slim.schema[0].dataType.simpleString()

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in batches(data, 1, blocks):
            arrays = [pa.array(out[f.name], type=f.type) for f in MATCH_ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *out])

    return slim.mapInArrow(W.tidy(run), f"`{doc_id}` {id_type}, {MATCH_SCHEMA}")


def remove_affected(
    docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    blocks = item_blocks(bench, item_id, item_text, window)
    column = docs.columns.index(text)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in batches(data, column, blocks):
            yield batch.filter(pa.array([n == 0 for n in out["n_hit"]]))

    return docs.mapInArrow(W.tidy(run), docs.schema)
