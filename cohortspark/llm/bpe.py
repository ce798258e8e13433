"""Byte-level pair encoding and decoding of whole texts with a given vocabulary.

Where a pre-token starts is found without a regular expression: every code point gets a class (letter, number, white
space, other; a space that glues to what follows, an apostrophe that may open a contraction), each class is a function
from the state before a character to the state after it, and a scan composes these functions. Composition is
associative and the functions are few, so it is one look-up in a table: blocks of characters are scanned side by side, then
the blocks' totals. Equal slices are merged once per chunk and kept in a cache of bounded size. The place where every
token starts is returned with the ids, and decoding writes each token's bytes there.

Texts never move; the vocabulary (at most ``VOCABULARY_BYTES``) is broadcast. Memory follows a chunk of about a megabyte or
the longest single text.

Defined results: null and empty texts have no tokens and decode to no bytes. Repeated rows and null ids each keep a row.
Only ``doc_id`` and ``text`` are read, so other columns may have any name. An empty table gives an empty table. An id
outside the vocabulary, or offsets that do not fit the ids, make decoding fail rather than return other bytes.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from cohortspark.llm import words as W

VOCABULARY_BYTES = 64 << 20
# Entries and bytes of a slice in a worker's cache of merged slices; beyond them it starts anew or does not keep it.
CACHE_ENTRIES, CACHE_SLICE = 100_000, 256
BLOCK = 512
ROWS = 128  # decoded at a time
# Slices up to this many bytes are merged side by side, a join in each of them per round; longer ones by a heap.
SIDE_BY_SIDE = 64
NONE = np.iinfo(np.int64).max

# The contractions of the public pattern, which are pre-tokens of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

LETTER, NUMBER, OTHER, SPACE, LAST_SPACE, GLUE, SHORT, LONG = range(8)  # symbols
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, GLUED, ONE_MORE, TWO_MORE = range(8)  # states before a character


def step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a character and whether a pre-token starts at it."""
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):  # rest of a contraction
            return (FRESH if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, GLUED)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, GLUED)
    if symbol in (SHORT, LONG) and state not in (IN_OTHER, GLUED):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (IN_OTHER, GLUED)
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (GLUED if symbol == GLUE else FRESH), True


class Transitions:
    """The functions that strings of symbols can be, numbered, with the table of their composition.

    Numbers 0 to 7 are the symbols, 8 to 15 the same at the first character of a text, 16 is the identity.
    """

    def __init__(self) -> None:
        first = [tuple(step(s, x)[0] for s in range(8)) for x in range(8)]
        anew = [(step(FRESH, x)[0],) * 8 for x in range(8)]
        functions = [*first, *anew, tuple(range(8))]
        number = {f: k for k, f in reversed(list(enumerate(functions)))}
        at = 0
        while at < len(functions):
            for g in functions[:17]:
                made = tuple(g[s] for s in functions[at])
                if made not in number:
                    number[made] = len(functions)
                    functions.append(made)
            at += 1
        self.after = np.array(functions, dtype=np.uint8)
        self.then = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint16)
        self.starts = np.array([[step(s, x)[1] for x in range(8)] for s in range(8)])
        self.identity = 16

    def prefixes(self, functions: np.ndarray) -> np.ndarray:
        """Composition of every prefix: columns of ``BLOCK`` at once, then the blocks' totals the same way."""
        n = len(functions)
        blocks = -(-n // BLOCK)
        grid = np.full(blocks * BLOCK, self.identity, dtype=np.uint16)
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        for j in range(1, BLOCK):
            grid[j] = self.then[grid[j - 1], grid[j]]
        if blocks > 1:
            before = np.full(blocks, self.identity, dtype=np.uint16)
            before[1:] = self.prefixes(grid[-1])[:-1]
            grid = self.then[before[None, :], grid]
        return grid.T.reshape(-1)[:n]

    def boundaries(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character; ``first`` marks the first character of a text."""
        if not len(symbols):
            return np.zeros(0, dtype=bool)
        states = self.after[self.prefixes(symbols + 8 * first), FRESH]
        before = np.full(len(symbols), FRESH, dtype=np.uint8)
        before[1:] = states[:-1]
        before[first] = FRESH
        return self.starts[before, symbols]


def classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the library whose results are to be met."""
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000])
    text = "".join(map(chr, points.tolist()))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        bytewise = tiktoken.Encoding(
            pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}
        )
        found = bytes(bytewise.encode_ordinary(text)).decode()
        out[np.fromiter(map(ord, found), dtype=np.int64, count=len(found))] = kind
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte each begins at."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.int32)
    points = lead.copy()
    padded = np.concatenate([raw, np.zeros(3, dtype=np.uint8)])
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = (lead >= least) & ((lead < (least >> 1 | 0x80)) if more < 3 else True)
        where = at[some]
        if len(where):
            value = lead[some] & mask
            for k in range(1, more + 1):
                value = value << 6 | (padded[where + k] & 0x3F)
            points[some] = value
    return points, at


class Tokenizer:
    """A vocabulary of byte strings with ranks, and what splitting and decoding need."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.classes = classes()
        self.transitions = Transitions()
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.full(size, -1, dtype=np.int64)
        by_id = [b""] * size
        for token, k in ranks.items():
            self.lengths[k], by_id[k] = len(token), token
        self.begins = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            ranks[token[:k]] * size + ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = self.classes[points].astype(np.uint16)
        last = np.ones(len(points), dtype=bool)
        last[:-1] = first[1:]
        blank = out == SPACE
        ahead = np.zeros(len(points), dtype=bool)  # something other than white space follows in the same text
        ahead[:-1] = ~blank[1:] & ~last[:-1]
        out[blank & ahead] = LAST_SPACE
        out[(points == 0x20) & ahead] = GLUE
        quotes = np.flatnonzero((points == ord("'")) & ~last)
        for c in CONTRACTIONS:
            fits = quotes[quotes + len(c) <= len(points)]
            for k in range(1, len(c)):
                fits = fits[(points[fits + k] == ord(c[k])) & ~first[fits + k]]
            out[fits] = SHORT if len(c) == 2 else LONG
        return out

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets where the pre-tokens of the texts start."""
        points, at = code_points(raw)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets[:-1]] = True
        first = first[at]
        return at[self.transitions.boundaries(self.symbols(points, first), first)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every joined pair of ids, NONE where the vocabulary lacks it."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        sought = left * len(self.lengths) + right
        at = np.minimum(np.searchsorted(self.pairs, sought), len(self.pairs) - 1)
        return np.where(self.pairs[at] == sought, self.joined[at], NONE)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: in each the neighbouring pair of lowest rank is joined, the leftmost first, until none is known."""
        out = [() if (known := self.ranks.get(p)) is None else (known,) for p in pieces]
        short = [k for k, p in enumerate(pieces) if not out[k] and len(p) <= SIDE_BY_SIDE]
        for k, p in enumerate(pieces):
            if not out[k] and len(p) > SIDE_BY_SIDE:
                out[k] = self.merge(p)
        part = self.single[np.frombuffer(b"".join([pieces[k] for k in short]), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(short)), [len(pieces[k]) for k in short])
        rank = np.full(len(part), NONE)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(part[:-1], part[1:]), NONE)
        ended = []
        while len(part):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(begins, len(part)))
            least = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            going = least != NONE
            ended.append((owner[~going], part[~going]))
            part, owner, rank, least = part[going], owner[going], rank[going], least[going]
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])] if len(at) else at
            part[at] = rank[at]
            kept = np.ones(len(part), dtype=bool)
            kept[at + 1] = False
            part, owner, rank = part[kept], owner[kept], rank[kept]
            at -= np.arange(len(at))  # one part before it went in each earlier slice
            for left in (at - 1, at):
                inside = (left >= 0) & (left + 1 < len(part))
                same = left[inside]
                rank[left[left >= 0]] = NONE
                same = same[owner[same] == owner[same + 1]]
                rank[same] = self.rank(part[same], part[same + 1])
        if ended:
            owner, part = (np.concatenate(x) for x in zip(*ended, strict=True))
            order = np.argsort(owner, kind="stable")
            flat, ends = part[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
            for k, a, b in zip(short, [0, *ends], ends, strict=False):
                out[k] = tuple(flat[a:b])
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token, by a heap of its pairs."""
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = self.ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue  # one of the two was joined with another part since
            end[i], end[j] = stop, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = self.ranks.get(piece[i : end[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[k]))
            k = before[i]
            if k >= 0:
                rank = self.ranks.get(piece[k:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of different pre-tokens, from the cache where it has them."""
        out = list(map(self.cache.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        new = [pieces[k] for k in missing]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
        for k, piece, ids in zip(missing, new, self.merge_all(new), strict=True):
            out[k] = ids
            if len(piece) <= CACHE_SLICE and len(self.cache) < CACHE_ENTRIES:
                self.cache[piece] = ids
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the byte of its text each token starts at, and the number of the first token of every text, plus one entry."""
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        places = self.split(raw, offsets)
        if not len(places):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(places, len(raw)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
        coded = slices.dictionary_encode()
        merged = self.merged(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
        flat = np.fromiter(chain.from_iterable(merged), dtype=np.uint32, count=int(sizes.sum()))
        which = coded.indices.to_numpy()
        ids = flat[spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
        lengths = self.lengths[ids]
        starts = np.cumsum(lengths) - lengths
        text_start = np.searchsorted(starts, offsets)
        starts -= np.repeat(offsets[:-1], np.diff(text_start))
        return ids, starts.astype(np.uint32), text_start

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The tokens' bytes, each written at its offset."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        if len(starts) != len(ids) or not np.array_equal(starts, np.cumsum(lengths) - lengths):
            raise ValueError("the offsets do not fit the ids")
        out = np.zeros(int(lengths.sum()), dtype=np.uint8)
        out[spread(starts.astype(np.int64), lengths)] = self.bytes[spread(self.begins[ids], lengths)]
        return out.tobytes()


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for sizes[0] places, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def load(path: str) -> Tokenizer:
    """Tokenizer of a rank file: a base64 byte string and its rank on every line. Read by the driver, which ships it."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary that is broadcast")
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Tokenizer({base64.b64decode(token): int(rank) for token, rank in pairs})


def encode(docs: DataFrame, tokenizer: Tokenizer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, n_tokens, ids and starts.

    ``ids`` and ``starts`` (the byte of the text at which a token starts) are packed little-endian unsigned 32-bit
    integers, the form in which token files hold them.
    """
    slim = docs.select(doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in data:
            for a, b, raw, offsets in W.chunks(batch.column(1)):
                ids, starts, first = known.encode(raw, offsets)
                packed = [
                    pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], type=pa.binary())
                    for x in (ids.astype("<u4"), starts.astype("<u4"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.diff(first)), *packed],
                    names=[batch.schema.names[0], "n_tokens", "ids", "starts"],
                )

    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, ids binary, starts binary")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The rows of ``encode`` with their column ``decoded``, the bytes of the text (binary)."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    ids, starts = encoded.columns.index("ids"), encoded.columns.index("starts")

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in data:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                packed = zip(part.column(ids).to_pylist(), part.column(starts).to_pylist(), strict=True)
                out = [known.decode(np.frombuffer(i or b"", "<u4"), np.frombuffer(s or b"", "<u4")) for i, s in packed]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, "decoded"]
                )

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", BinaryType())]))
