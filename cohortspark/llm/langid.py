"""Language identification by cross-parsing entropy.

A suffix automaton per language is built from a bounded sample of its labelled text; from its start state exactly the
substrings of that sample can be followed. A text is parsed into phrases, each the longest one the automaton can
follow from where the last one ended. Text like the sample needs few phrases: phrases x log2(sample length) / text
length estimates the cross entropy, and the language with the least wins.

The automata are one transition table. A missing transition leads where a new phrase that begins with the symbol leads,
marked as such, so a parse is one table look-up per byte. Texts are parsed in pieces of ``PIECE`` bytes, many pieces at
once; a phrase ends with its piece, for every language alike, and no byte is left out.

The sample: for each language ``SAMPLE_DOCS`` documents with the smallest hash of their id, ``EXCERPT`` bytes from a
place inside each (all of a shorter one), at most ``TABLE_BYTES`` of text over all languages. These bounds make the broadcast table bounded.
Scoring covers whole texts.

Defined results: null or empty texts and texts without a letter are ``und`` with score 0; with nothing to learn from
every text is ``und``. Ties go to the language that sorts first. Rows with a null language teach nothing. Repeated rows
get equal results. Columns besides the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm import words as W

SAMPLE_DOCS = 96
EXCERPT = 256
TABLE_BYTES = 256 << 10
PIECE = 256
UNKNOWN = "und"
RESULT = "lang_pred string, score double, phrases_per_kb double"

# Symbols of the automata: lower-cased letters and bytes of longer characters by themselves, all else one separator.
_SYMBOL_BYTE = np.full(256, 0x20, dtype=np.uint8)
_SYMBOL_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
_SYMBOL_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
_SYMBOL_BYTE[0x80:] = np.arange(0x80, 0x100)


def plain(raw: np.ndarray) -> np.ndarray:
    return _SYMBOL_BYTE[raw]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of ``text``; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


class Parser:
    """All languages' automata as one table; picklable, a few megabytes to some hundred by the sample's bound."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        used = sorted({b for text in samples.values() for b in text})
        # Symbol 0: not in any sample. The last symbol: past the end of a text.
        self.symbol = np.zeros(256, dtype=np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 2
        self.end = self.width - 1
        rows, self.start = [], []
        self.bits = [float(np.log2(max(len(samples[lang]), 2))) for lang in self.langs]
        base = 0
        for lang in self.langs:
            go = suffix_automaton(samples[lang])
            table = np.zeros((len(go), self.width), dtype=np.int32)
            first = np.full(self.width, (base * self.width) << 1 | 1, dtype=np.int32)
            for b, s in go[0].items():
                first[self.symbol[b]] = ((base + s) * self.width) << 1 | 1
            table[:] = first
            for k, edges in enumerate(go):
                for b, s in edges.items():
                    table[k, self.symbol[b]] = ((base + s) * self.width) << 1
            table[0] = first
            # Past the end nothing is counted and the state no longer matters.
            table[:, self.end] = (base * self.width) << 1
            rows.append(table)
            self.start.append(base * self.width)
            base += len(go)
        self.table = np.concatenate(rows).ravel()

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of every text and language."""
        base, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        symbols = self.symbol[plain(raw[offsets[0] : offsets[-1]])]
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = base[owner] + number * PIECE
        left = np.minimum(sizes[owner] - number * PIECE, PIECE)
        # Long pieces first: those still running are a leading part, so ended ones cost nothing.
        order = np.argsort(-left, kind="stable")
        owner, at, left = owner[order], at[order], left[order]
        running = np.searchsorted(-left, -np.arange(1, PIECE + 1), side="right")
        out = np.zeros((len(sizes), len(self.langs)), dtype=np.int64)
        for k, start in enumerate(self.start):
            state = np.full(len(at), start, dtype=np.int32)
            count = np.zeros(len(at), dtype=np.int32)
            for step in range(PIECE):
                n = running[step]
                if n == 0:
                    break
                to = self.table[state[:n] + symbols[at[:n] + step]]
                count[:n] += to & 1
                state[:n] = to >> 1
            out[:, k] = np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64)
        return out

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence (how much fewer normalised phrases than the next language) and phrases per kilobyte."""
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        langs, scores, rates = [], [], []
        for a, b, raw, offsets in W.chunks(column):
            counts = self.phrases(raw, offsets)
            cost = counts * np.array(self.bits)
            best = cost.argmin(axis=1)
            least = cost[np.arange(b - a), best]
            if len(self.langs) > 1:
                second = np.partition(cost, 1, axis=1)[:, 1]
                with np.errstate(invalid="ignore", divide="ignore"):
                    sure = np.where(second > 0, 1 - least / second, 0.0)
            else:
                sure = np.ones(b - a)
            sizes = np.maximum(np.diff(offsets), 1)
            langs += [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters[a:b], strict=True)]
            scores.append(np.where(letters[a:b], np.clip(sure, 0, 1), 0.0))
            rates.append(counts[np.arange(b - a), best] * 1024.0 / sizes)
        join = lambda x: np.concatenate(x) if x else np.zeros(0)
        return langs, join(scores), join(rates)


def fit(docs: DataFrame, trainable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Parser | None:
    """Parser from the rows for which ``trainable`` holds; None if they teach nothing."""
    key = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs.where(trainable & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    # The rank limit is applied in every task before rows of a language meet, so a hot language costs nothing more.
    slim = rows.select(F.col(lang).alias("lang"), key.alias("k"), F.col(text).alias("text"))
    place = F.pmod(F.col("k"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    slim = slim.select("lang", "k", F.substring(F.col("text"), place, F.lit(EXCERPT)).alias("text"))
    order = Window.partitionBy("lang").orderBy("k", "text")
    picked = slim.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS).toArrow()
    picked = picked.sort_by([("lang", "ascending"), ("n", "ascending")])
    by_lang: dict[str, list[str]] = {}
    for name, sample in zip(picked["lang"].to_pylist(), picked["text"].to_pylist(), strict=True):
        by_lang.setdefault(name, []).append(sample)
    each = min(SAMPLE_DOCS * EXCERPT, TABLE_BYTES // max(len(by_lang), 1))
    samples = {}
    for name, texts in by_lang.items():
        data = plain(np.frombuffer(" ".join(texts).encode()[:each], dtype=np.uint8)).tobytes()
        if data.strip():
            samples[name] = data
    return Parser(samples) if samples else None


def identify(docs: DataFrame, parser: Parser | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, lang_pred, score (0 to 1), phrases_per_kb."""
    slim = docs.select(F.col(doc_id), F.col(text))
    if parser is None:
        return slim.select(
            doc_id, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("phrases_per_kb")
        )
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            langs, scores, rates = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, type=pa.string()), pa.array(scores), pa.array(rates)],
                names=[batch.schema.names[0], "lang_pred", "score", "phrases_per_kb"],
            )

    return slim.mapInArrow(W.tidy(run), f"`{doc_id}` {slim.schema[0].dataType.simpleString()}, {RESULT}")


def keep_identified(docs: DataFrame, parser: Parser | None, text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which a language was found."""
    if parser is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    column = docs.columns.index(text)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            langs, _, _ = shared.value.score(batch.column(column))
            yield batch.filter(pa.array([x != UNKNOWN for x in langs], type=pa.bool_()))

    return docs.mapInArrow(W.tidy(run), docs.schema)
