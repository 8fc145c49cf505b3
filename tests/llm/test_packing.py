import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamarack.llm import packing

TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zz.\n,'s é😀\t19 \xa0", max_size=60))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.Encoder().ids(text) == np.array(ids(text), "<u4").tobytes()


def test_special_token_and_long_text():
    text = "a <|endoftext|> b\n" + "word " * 3000
    assert packing.Encoder().ids(text) == np.array(ids(text), "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_place_each_piece_once(histogram):
    packed = packing.patterns(histogram, 64)
    total = {}
    for n, runs in packed:
        assert sum(x * c for x, c in runs) <= 64
        for x, c in runs:
            total[x] = total.get(x, 0) + n * c
    assert total == histogram


def test_pack(documents):
    rows = [(1, "Hello there, world. " * 900), (2, None), (3, ""), (3, ""), (None, "some words"), (4, "one"), (5, "one")]
    out = packing.pack(documents(rows, extra=True)).collect()
    assert packing.pack(documents([])).count() == 0
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert [len(by_doc[i]) for i in (2, 3, None)] == [1, 2, 1]
    for i, text in ((1, rows[0][1]), (2, ""), (None, "some words")):
        whole = np.array([*ids(text), 1], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == np.append(0, np.cumsum([r.length for r in parts]))[:-1].tolist()
        assert sum(r.length for r in parts) == len(whole) == parts[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in parts)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_padding_is_little():
    """Lengths as texts have them: few positions stay empty, but for the last sequences."""
    rng = np.random.default_rng(6)
    lengths = np.minimum(np.exp(rng.normal(5.5, 1.2, 200_000)).astype(int) + 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    packed = packing.patterns(histogram)
    assert sum(n for n, _ in packed) <= 1.001 * lengths.sum() / 2048 + 1


def test_pieces_of_a_common_length_are_dealt_over_salts(documents):
    rows = [(i, "same words here") for i in range(500)] + [(1000 + i, "word " * i) for i in range(60)]
    out = packing.pack(documents(rows), salted=40).collect()
    assert len(out) == len(rows) and len({(r.sequence_id, r.offset) for r in out}) == len(rows)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for p, n in parts if p < o) for parts in sequences.values() for o, _ in parts)
    assert len(sequences) == -(-sum(r.length for r in out) // 2048)
