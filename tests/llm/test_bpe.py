"""Byte-level encoding against the tokenizer library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import bpe
from cohortspark.llm.op13_bpe import VOCABULARY, op13_bpe
from tests.conftest import SMALL
from tests.llm.helpers import table

TOKENIZER = bpe.load(public_tokenizers.path(VOCABULARY))
LIBRARY = tiktoken.Encoding(
    "library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TOKENIZER.ranks, special_tokens={}
)
HARD = [
    "",
    " ",
    "  ",
    "\n",
    " \n",
    "\n 's",
    " \n's it's 'tis 'sabc 're'll've'd'm'x ''s '' s",
    "a  b\t\tc  d  e  f",
    "x 12 345abc٢௰ Ⅷ½",
    "don't DON'T don’t they'll they'l they're 'r 're",
    "é́中文 \U0001f600\U0001f600  \U0001d400﻿​͸\U000e0001",
    "tail space ",
    "tail spaces  \n ",
    "\x1c\x1d\x1e\x1f\x85\x00",
    "<|endoftext|> ??!! --'s--'s 's's",
    "a" * 3000,
    "'" * 301 + "s",
    "ab\r\n\r\n  cd",
]


def encoded(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    ids, starts, first = TOKENIZER.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return [(ids[a:b], starts[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def check(texts):
    for text, (ids, starts) in zip(texts, encoded(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert TOKENIZER.decode(ids, starts) == text.encode()


def test_hard_texts_as_the_library():
    check(HARD)
    check(["".join(HARD)])


ALPHABET = st.one_of(st.sampled_from("'srtvelmd abAB1 \n\t .,-é"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=6))
def test_any_texts_as_the_library(texts):
    check(texts)


def test_every_code_point_beside_every_class():
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for before, after in (("a", "1"), (" ", "'s")):
        check(["".join(before + p + after for p in points[k : k + 50_000]) for k in range(0, len(points), 50_000)])


def test_long_slices_merge_as_the_library():
    text = "abcabcab" * 20_000
    check([text])


def test_blocks_join(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 4)
    check(HARD)
    check(["".join(HARD) * 3])


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    check(HARD * 2)


def test_wrong_ids_and_offsets_fail():
    ids, starts = encoded(["some text"])[0]
    with pytest.raises(ValueError, match="vocabulary"):
        TOKENIZER.decode(np.append(ids, np.uint32(999_999)), np.append(starts, 0))
    with pytest.raises(ValueError, match="offsets"):
        TOKENIZER.decode(ids, starts + 1)


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "It's  it", "x", 1), (1, "It's  it", "y", 2), (None, None, "z", 3), (None, "", None, None), (2, None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out if r.doc_id) == [(1, b"It's  it")] * 2 + [(2, b"")]
    assert [(r.n_tokens, bytes(r.decoded)) for r in out if r.doc_id is None] == [(0, b"")] * 2
    assert bpe.encode(docs.limit(0), TOKENIZER).count() == 0


def test_query_as_the_library(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op13_bpe(spark, SMALL).collect()}
    want = {}
    for r in table(spark, "documents").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        packed, data = np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode_bytes(ids)
        want[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest())
    assert got == want
