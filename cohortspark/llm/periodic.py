"""Runs of words with a period: maximal stretches in which words q apart are identical.

Scales are octaves of periods, S <= p < 2S. For an octave a text is cut at boundaries at most as far apart as the shortest
stretch of matches (word i equals word i + p) that a run needs, so every run's stretch holds a boundary. A tile is a
range of boundaries with the words that their octave can reach. A tile is solved by itself: the Z-function of the words
after a boundary and that of the reversed words before it give, for all periods of the octave at once, how far matches
reach to both sides, cut at the tile's reach. These fragments are shuffled by document and period and stitched where
they touch. Periods that are a multiple of a smaller one are left out by the Z-function as well.

Tiles without a recurrence are not made: a stretch of matches holds a window of words that recurs at a distance of the
octave, so boundaries without such a window nearby cannot see a run. Equal windows are found by hash, which can only make
a tile too many. Texts without a tile have no run and never move; of the others tiles, fragments and the text are
shuffled, tiles one by one, so a long text is solved in many tasks. An octave costs time in proportion to the words.

Defined results: null, empty and blank texts have no words and no runs. Every row is judged by itself, so repeated rows
and null ids give a result each. Other columns are not read and may have any name. An empty table gives an empty table.
Rows are told apart by their place in the input, which must not change when a task is repeated (files and tables do).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import words as W
from cohortspark.session import shuffle_partitions

LEAST = 12  # words of the shortest run, see ``least_matches``
WINDOW = 4
TILE = 4096  # words between the first and the last boundary of a tile, at least one boundary
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def least_matches(size: int) -> int:
    """Fewest consecutive matches of a run with a period of the octave: max(12, 2p) - p at its least."""
    return min(max(LEAST - p, p) for p in range(size, min(2 * size, LEAST + size)))


def spacing(size: int) -> int:
    """Distance of boundaries: no stretch of ``least_matches`` is without one."""
    return size if size >= 8 else {1: 8, 2: 8, 4: 4}[size]


def reach(size: int) -> int:
    """Words a tile sees on both sides of a boundary; more than any stretch needs to be known for a run's."""
    return max(2 * size, 16)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the number of each text's first word, plus one entry."""
    inside = W.UNSPACED[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge |= first
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    word = inside[starts] if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(starts, offsets)


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words (by their bytes, not by a hash)."""
    if not len(starts):
        return np.zeros(0, dtype=np.int32)
    cuts = np.empty(2 * len(starts) + 1, dtype=np.int32)
    cuts[:-1:2], cuts[1::2], cuts[-1] = starts, ends, ends[-1]
    slices = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())])
    return slices.dictionary_encode().indices.to_numpy()[::2].astype(np.int32)


def candidates(ids: np.ndarray, text_start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size of the octave, text, boundary) of the boundaries near which a window recurs at a distance of the octave.

    Windows double with the octaves. Of a text's windows only those that recur in it are kept: a longer one that recurs
    consists of such.
    """
    n, counts = len(ids), np.diff(text_start)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole, place = np.repeat(counts, counts), np.arange(n)
    left = np.repeat(text_start[1:], counts) - place  # words to the end of the text
    hashed = W.mix(ids.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    window, size, group, line = 1, 1, place, place
    while True:
        long_enough = whole[place] >= 2 * size
        place, group = place[long_enough], group[long_enough]
        wanted = WINDOW if size <= 8 else size // 2
        if window < wanted:
            while window < wanted:
                place = place[left[place] >= 2 * window]
                hashed[place] = W.mix(hashed[place] * np.uint64(0xD6E8FEB86659FD93) + hashed[place + window])
                window *= 2
            key = hashed[place]
            order = np.argsort(key)
            group = np.zeros(len(place), dtype=np.int64)
            group[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            shared = np.bincount(group)[group] > 1 if len(group) else group > 0
            place, group = place[shared], group[shared]
            line = np.sort(group * (2 * n + 2) + place)
        if not len(place):
            return
        sought = group * (2 * n + 2) + place + size
        at = np.searchsorted(line, sought)
        found = at < len(line)
        found[found] = line[at[found]] < sought[found] + size
        hits = place[found]
        step, begin = spacing(size), text_start[owner[hits]]
        boundary = -(-(hits - begin) // step) * step
        inside = boundary < whole[hits]
        pairs = np.unique(owner[hits][inside] * (n + 1) + boundary[inside])
        if len(pairs):
            yield size, pairs // (n + 1), pairs % (n + 1)
        size *= 2


def tiles(ids: np.ndarray, text_start: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int, np.ndarray]]:
    """(text, size of the octave, boundaries, number of the first word, words) of every tile that may see a run."""
    for size, texts, boundaries in candidates(ids, text_start):
        cut = np.flatnonzero((np.diff(texts) != 0) | (np.diff(boundaries // max(TILE, size)) != 0)) + 1
        for a, b in zip([0, *cut], [*cut, len(texts)], strict=True):
            begin, end = text_start[texts[a]], text_start[texts[a] + 1]
            low = max(int(boundaries[a]) - reach(size), 0)
            high = min(int(boundaries[b - 1]) + reach(size) + 2 * size, int(end - begin))
            yield int(texts[a]), size, boundaries[a:b], low, ids[begin + low : begin + high]


def z_function(s: list[int]) -> list[int]:
    """For every place the length of the longest common prefix of s and s from there on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != s[0]:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def solve(size: int, boundaries: Iterable[int], low: int, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the matches around the boundaries, as numbers of words of the text."""
    far, step, s = reach(size), spacing(size), words.tolist()
    for boundary in boundaries:
        b = boundary - low
        after = z_function(s[b : b + far + 2 * size])
        periods = [p for p in range(size, min(2 * size, len(after))) if after[p]]
        if not periods:
            continue
        # Reversed: what stands before the boundary, a mark no word has, then the words up to the farthest period.
        stop = min(b + 2 * size, len(s))
        before = z_function([*s[max(b - far, 0) : b][::-1], -1, *s[max(b - far, 0) : stop][::-1]])
        base = b - max(b - far, 0) + 1
        for p in periods:
            forward, back = min(after[p], far), min(before[base + stop - b - p], far)
            if forward + back < max(p, LEAST - p):
                continue
            if back >= step and forward <= far - step:
                continue  # the boundary before sees all of it
            if any(after[p // f] >= p - p // f for f in prime_factors(p)):
                continue  # the words repeat with a smaller period
            yield p, boundary - back, boundary + forward


def kept_words(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that no run holds after its first period; runs are (start, length, period)."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, raw, offsets in W.chunks(batch.column(1)):
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, text_start = word_bounds(raw, offsets)
        yield a, b, raw, starts, ends, text_start, word_numbers(raw, starts, ends)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    data = raw.tobytes()
    return b" ".join([data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]).decode()


def _without_tiles(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the texts that have no tile, with no runs and all of their words."""
    for batch in data:
        for a, b, raw, starts, ends, text_start, ids in _numbered(batch):
            tiled = {int(t) for _, texts, _ in candidates(ids, text_start) for t in np.unique(texts)}
            rest = [k for k in range(b - a) if k not in tiled]
            at = [slice(text_start[k], text_start[k + 1]) for k in rest]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([a + k for k in rest], type=pa.int64())),
                    pa.array([s.stop - s.start for s in at], type=pa.int64()),
                    pa.array([[] for _ in rest], type=RUNS),
                    pa.array([_joined(raw, starts[s], ends[s]) for s in at], type=pa.string()),
                ],
                names=[batch.schema.names[0], "n_words", "runs", "collapsed"],
            )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
# Rows on their way; task and row name the document, only its text has its id. A text has no octave and no period.
MOVING = "task int, row long, octave long, piece long, boundaries binary, low long, words binary, text string"
MOVING_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()]
FOUND = "task int, row long, period long, start long, end long, text string"
FOUND_TYPES = [pa.int32(), *[pa.int64()] * 4, pa.string()]
ROWS = 256  # rows turned into Python values at a time


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pieces_of(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in data:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _batch(rows: list[tuple], kinds: list[pa.DataType], columns: list[str]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(values, kinds, strict=True)], names=columns)


def _exploded(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the texts that have some, and these texts."""
    task, row = TaskContext.get().partitionId(), 0
    for batch in data:
        for a, b, _, _, _, text_start, ids in _numbered(batch):
            rows, pieces = [], {}
            for k, size, boundaries, low, part in tiles(ids, text_start):
                pieces[k] = pieces.get(k, 0) + 1
                packed = boundaries.astype("<i8").tobytes(), low, part.astype("<i4").tobytes()
                rows.append((None, task, row + k, size, pieces[k], *packed, None))
            for k in pieces:
                id_, text = batch.column(0)[a + k].as_py(), batch.column(1)[a + k].as_py()
                rows.append((id_, task, row + k, None, 0, None, None, None, text))
            row += b - a
            yield _batch(rows, [batch.column(0).type, *MOVING_TYPES], ["id", *names(MOVING)])


def _solved(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles; texts pass."""
    for part in pieces_of(data):
        out: list[tuple] = []
        for r in part.to_pylist():
            if r["octave"] is None:
                out.append((r["id"], r["task"], r["row"], None, None, None, r["text"]))
                continue
            boundaries = np.frombuffer(r["boundaries"], dtype="<i8").tolist()
            found = solve(r["octave"], boundaries, r["low"], np.frombuffer(r["words"], dtype="<i4"))
            out += [(None, r["task"], r["row"], *f, None) for f in found]
        yield _batch(out, [part.column(0).type, *FOUND_TYPES], ["id", *names(FOUND)])


def _stitched(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of the fragments of one document and period that overlap or touch, which come sorted; texts pass."""
    key, start, end, id_type = None, 0, 0, None
    for part in pieces_of(data):
        out, id_type = [], part.column(0).type
        for r in part.to_pylist():
            if r["period"] is None:
                out.append(tuple(r.values()))
                continue
            now = (r["task"], r["row"], r["period"])
            if now == key and r["start"] <= end:
                end = max(end, r["end"])
                continue
            if key is not None:
                out.append((None, *key, start, end, None))
            key, start, end = now, r["start"], r["end"]
        yield _batch(out, [id_type, *FOUND_TYPES], ["id", *names(FOUND)])
    if key is not None:
        yield _batch([(None, *key, start, end, None)], [id_type, *FOUND_TYPES], ["id", *names(FOUND)])


def _finished(name: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs and kept words of each text; its runs come before it, by start and period."""

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[int, int, int]] = []
        for part in pieces_of(data):
            out = []
            for r in part.to_pylist():
                if r["period"] is not None:
                    runs.append((r["start"], r["end"] - r["start"] + r["period"], r["period"]))
                    continue
                raw = np.frombuffer((r["text"] or "").encode(), dtype=np.uint8)
                starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
                kept = kept_words(len(starts), runs)
                shown = [{"start": a, "length": n, "period": p} for a, n, p in runs]
                out.append((r["id"], len(starts), shown, _joined(raw, starts[kept], ends[kept])))
                runs = []
            yield _batch(out, [part.column(0).type, pa.int64(), RUNS, pa.string()], [name, "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, n_words, runs (by start, then period) and collapsed.

    ``runs`` holds structs of start (number of a word), length in words, and period; ``collapsed`` is the text's words, joined by
    single blanks, without those that a run repeats after its first period.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = slim.schema[0].dataType.simpleString()
    result = f"`{doc_id}` {kind}, n_words long, runs array<{RUN}>, collapsed string"
    rest = slim.mapInArrow(_without_tiles, result)
    parts = shuffle_partitions(docs.sparkSession)
    moving = slim.mapInArrow(_exploded, f"id {kind}, {MOVING}")
    found = moving.repartition(parts, "task", "row", "octave", "piece").mapInArrow(_solved, f"id {kind}, {FOUND}")
    by_period = found.repartition(parts, "task", "row", "period").sortWithinPartitions("task", "row", "period", "start")
    stitched = by_period.mapInArrow(_stitched, f"id {kind}, {FOUND}")
    # A text comes after its runs: it has no start.
    by_text = stitched.repartition(parts, "task", "row").sortWithinPartitions(
        "task", "row", F.col("start").asc_nulls_last(), "period"
    )
    return rest.unionByName(by_text.mapInArrow(_finished(doc_id), result))
