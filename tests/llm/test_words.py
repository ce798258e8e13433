import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import words as W
from tests.llm.helpers import unspaced, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \n\t,éß漢 .-", max_size=30)), max_size=8)


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_patterns(texts, limit):
    for mask, plain in ((W.LETTERS, words), (W.UNSPACED, unspaced)):
        got = []
        for _, _, raw, offsets in W.chunks(pa.array(texts, pa.string()), limit):
            found = W.split(raw, offsets, mask)
            for a, b in zip(found.text_start[:-1], found.text_start[1:], strict=True):
                got.append([found.word(i).decode() for i in range(a, b)])
        assert got == [plain(t) for t in texts]


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_equal_words_have_equal_hashes_and_others_do_not(texts):
    raw, offsets = W.strings(pa.array(texts, pa.large_string()))
    found = W.split(raw, offsets)
    by_word = {}
    for i, h in enumerate(found.hashes().tolist()):
        assert by_word.setdefault(found.word(i), h) == h
    assert len(set(by_word.values())) == len(by_word)
    for i, h in enumerate(found.hashes(2).tolist()):
        same = [j for j in range(len(found)) if found.word(j)[:2] == found.word(i)[:2]]
        assert (found.hashes(2)[same] == np.uint64(h)).all()


def test_sliced_column():
    column = pa.array(["one two", None, "three", ""]).slice(1, 3)
    raw, offsets = W.strings(column)
    found = W.split(raw, offsets)
    assert [found.word(i) for i in range(len(found))] == [b"three"]
    assert found.text_start.tolist() == [0, 0, 1, 1]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = "the quick brown fox " * 30 + "x" * 500 + " and é the"
    raw, offsets = W.strings(pa.array([text, None, text], pa.large_string()))
    whole = W.split(raw, offsets).hashes()
    monkeypatch.setattr(W, "CHUNK_BYTES", 64)
    assert (W.split(raw, offsets).hashes() == whole).all()
    assert (W.split(raw, offsets).hashes(3) == W.Words(*vars(W.split(raw, offsets)).values()).hashes(3)).all()
