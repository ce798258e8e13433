"""Words of Arrow string columns as 64-bit hashes, found with whole-buffer numpy operations.

Texts are handled in chunks of about one megabyte (a longer text is a chunk of its own), so memory follows the chunk
and the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Bytes of words, after A-Z were lowered. Every byte of a multi-byte character is 0x80 or above.
LETTERS = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
UNSPACED = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]+
UNSPACED[0x20] = UNSPACED[0x09:0x0E] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, after which a task gives freed memory back: its worker waits for the next one beside the JVM."""

    @functools.wraps(run)
    def tidied(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(data)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator; a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _sums(low: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes times powers of the base; wrap-around is exact arithmetic modulo 2^64."""
    up, _ = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)


@dataclass
class Words:
    """Words of consecutive texts. ``text_start[i]`` is the number of the first word of text i; one more entry closes."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_start: np.ndarray
    sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_start) - 1), np.diff(self.text_start))

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Hash of every word, or of its first bytes (words with fewer get that of the word and one end mark)."""
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        if len(self.low) <= CHUNK_BYTES:
            if self.sums is None:
                self.sums = _sums(self.low)
            return _hashes(self.sums, self.starts, ends)
        # Longer buffers go piece by piece: a hash depends on the bytes of its word only, never on their place.
        out = np.empty(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            base = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, base + CHUNK_BYTES, side="right")))
            sums = _sums(self.low[base : self.ends[b - 1]])
            out[a:b] = _hashes(sums, self.starts[a:b] - base, ends[a:b] - base)
            a = b
        return out

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n, wide = len(column), pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def split(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = LETTERS) -> Words:
    """Words of the texts between ``offsets``; a word never crosses from one text into the next."""
    base = offsets[0]
    low = _LOWER[raw[base : offsets[-1]]]
    offsets = offsets - base
    inside = word_bytes[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(low, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of whole texts with about ``limit`` bytes."""
    raw, offsets = strings(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw, offsets[at : end + 1]
        at = end
