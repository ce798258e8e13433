"""SuperMinHash signatures of shingle sets, computed for many sets at once.

Every element x has a permutation of the m slots and, at its step j, the rank j plus a fraction; a slot keeps the
smallest rank of all elements. Elements go through their steps together. A step can only win slots that are still empty
after the step before, so a set is done as soon as all its slots are filled (early stopping): long sets after two or
three steps, short ones after at most m.

The permutation of x is j -> (b + a j) mod m with a prime m. Two slots of such a permutation are distributed as two slots
of a uniform one, and the variance of the estimate depends on pairs of slots only, so the lower variance is kept
without carrying a shuffled list for every element.
"""

from __future__ import annotations

import hashlib

import numpy as np

from cohortspark.llm import words as W

SLOTS = 131  # a prime
BANDS, ROWS = 32, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, ascending within a text, and where each text's begin.

    A text with fewer words than ``size``, but not none, has its whole sequence as the one shingle.
    """
    h = found.hashes()
    counts = np.diff(found.text_start)
    n = len(h)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        rolled[: max(n - k, 0)] = W.mix(rolled[: max(n - k, 0)] * np.uint64(31) + h[k:] + np.uint64(k))
    out, starts = [], np.zeros(len(counts) + 1, dtype=np.int64)
    for t, (a, b) in enumerate(zip(found.text_start[:-1].tolist(), found.text_start[1:].tolist(), strict=True)):
        if b - a >= size:
            mine = np.sort(rolled[a : b - size + 1])
            keep = np.ones(len(mine), dtype=bool)
            keep[1:] = mine[1:] != mine[:-1]
            mine = mine[keep]
        elif b > a:
            mine = np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8, person=b"whole").digest(), np.uint64)
        else:
            mine = h[:0]
        out.append(mine)
        starts[t + 1] = starts[t] + len(mine)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts


def set_keys(elements: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A 128-bit key of every set; equal sets have equal keys."""
    return [
        hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    ]


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` ranks per set (the step in the leading bits, the fraction below); an empty set is all ones."""
    n_sets = len(starts) - 1
    sig = np.full(n_sets * slots, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(starts))
    x = W.mix(elements + _STEP)
    b = (x & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
    a = (x >> np.uint64(32)) % np.uint64(slots - 1) + np.uint64(1)
    b, a, base = b.astype(np.int64), a.astype(np.int64), owner * slots
    for j in range(slots):
        fraction = W.mix(elements + np.uint64(int(_STEP) * (j + 2) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(9)
        at = base + b
        rank = (np.uint64(j) << np.uint64(55)) | fraction
        np.minimum.at(sig, at, rank)
        open_sets = (sig.reshape(n_sets, slots) == _EMPTY).any(axis=1)
        keep = open_sets[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner, base, a, b = elements[keep], owner[keep], base[keep], a[keep], b[keep]
        b = b + a
        b[b >= slots] -= slots
    return sig.reshape(n_sets, slots)


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per set and band; the band's number is part of it."""
    out = np.empty((len(sig), n_bands), dtype=np.uint64)
    for k in range(n_bands):
        h = np.full(len(sig), np.uint64(k + 1), dtype=np.uint64)
        for r in range(rows):
            h = W.mix(h * np.uint64(31) + sig[:, k * rows + r])
        out[:, k] = h
    return out


def fingerprints(sig: np.ndarray) -> np.ndarray:
    """Sixteen bits of every slot, enough to estimate similarity (two different ranks agree once in 65,536)."""
    return (W.mix(sig.copy()) >> np.uint64(48)).astype(np.uint16)
