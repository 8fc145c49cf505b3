import random

import pytest

from tamarack.llm import neardup

from . import brute
from .conftest import as_tuples


def family(seed=5):
    """Texts with exact copies, near copies, chains and a large family of loosely similar texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 300))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([6, 30, 80, 150]))]
        rows.append(text)
        rows += [text] * (base % 3)
        for _ in range(8):
            copy = list(rows[-1] if base % 2 else text)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_components_are_those_of_all_pairs(documents, k):
    rows = family()
    out = neardup.near_duplicates(documents(rows), k)
    assert as_tuples(out, "doc_id", "n_shingles", "component_id") == sorted(((i, n, c) for i, (n, c) in brute.components(rows, k).items()), key=repr)


def test_edges_of_the_contract(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b"), (7, "x " * 5000), (8, "X " * 4000)]
    out = {r.doc_id: r for r in neardup.near_duplicates(documents(rows, extra=True), 4).collect()}
    assert [out[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 7, 7]
    assert [out[i].n_shingles for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 1]
    assert out[None].component_id is None and out[None].kept
    assert not out[5].kept and out[4].kept


def test_empty_table_and_repeated_rows(documents):
    assert neardup.near_duplicates(documents([]), 4).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "q q q q r")]
    out = as_tuples(neardup.near_duplicates(documents(rows), 4), "doc_id", "component_id", "kept")
    assert out == [(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True)]


def test_one_of_each_keeps_columns(documents):
    docs = documents(family(), extra=True)
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    kept = {i for i, (_, c) in brute.components(family(), 5).items() if i == c}
    assert {r.doc_id for r in out.collect()} == kept


def test_components_joined_through_members_that_are_not_the_smallest(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (10, 10)], "id long, label long")
    links = spark.createDataFrame([(2, 6), (7, 9)], "a long, b long")
    assert as_tuples(neardup.joined(labels, links), "id", "label") == sorted([(i, 1) for i in (1, 2, 5, 6, 7, 8, 9)] + [(10, 10)], key=repr)


def test_crowds_of_chains_with_ids_in_any_order(documents):
    """Texts that are linked where they differ in one of eight words: most links are between two that aren't a centre."""
    rng = random.Random(2)
    texts = []
    for crowd in range(6):
        for bits in rng.sample(range(256), 70):
            text = [f"c{crowd}w{i}" for i in range(59)]
            for i in range(8):
                if bits >> i & 1:
                    text[5 + 6 * i] = f"c{crowd}s{i}"
            texts.append(" ".join(text))
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    out = neardup.near_duplicates(documents(rows), 4)
    assert as_tuples(out, "doc_id", "n_shingles", "component_id") == sorted(((i, n, c) for i, (n, c) in brute.components(rows, 4).items()), key=repr)


def test_other_texts_of_an_id_do_not_count_against_a_link(documents):
    short = [f"s{i}" for i in range(40)]
    rows = [(1, " ".join(f"long{i}" for i in range(300))), (1, " ".join(short)), (2, " ".join([*short[:-1], "other"]))]
    # Long texts meet as well, so the long one is a candidate.
    rows.append((3, " ".join([*(f"long{i}" for i in range(100)), *(f"else{i}" for i in range(50))])))
    out = as_tuples(neardup.near_duplicates(documents(rows), 4), "doc_id", "component_id", "kept")
    assert out == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
