import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import textkit as T

from .brute import fold

texts = st.lists(st.text(alphabet="aAbB \t\n\x0béß😀.", max_size=30), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern_and_equal_words_have_equal_hashes(rows):
    w = T.Words([t.encode() for t in rows])
    names = {}
    for i, t in enumerate(rows):
        own = w.hash[w.first[i] : w.first[i + 1]]
        assert len(own) == len(fold(t))
        for word, h in zip(fold(t), own.tolist(), strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles(rows, k):
    w = T.Words([t.encode() for t in rows])
    values, first = T.distinct(*T.shingles(w.hash, w.first, k))
    for i, t in enumerate(rows):
        words = fold(t)
        expected = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
        assert first[i + 1] - first[i] == len(expected)
    assert np.all(np.diff(first) >= 0)


def test_chunks_cover_all_texts():
    rows = [b"x" * n for n in (0, 5, 3, 100, 0, 7)]
    got = [i for a, b in T.chunks(rows, 8) for i in range(a, b)]
    assert got == list(range(6))
    assert list(T.chunks([], 8)) == []
