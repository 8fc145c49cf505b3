import random

from tamarack.llm import linedup

from . import brute


def pages(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{i}" for i in range(60))])
    base = [[word() for _ in range(rng.choice([4, 5, 6, 9, 14, 30]))] for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(3, 12))]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x))
                x[i : i + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            lines.append("  ".join(w.upper() if rng.random() < 0.2 else w for w in x))
        rows.append((d, "\n".join(lines)))
    return rows


def test_same_lines_go_as_by_comparing_all(documents):
    rows = pages()
    out = linedup.dedup_lines(documents(rows)).collect()
    assert {r.doc_id: list(r.dropped) for r in out if r.dropped} == brute.dropped_lines(rows)
    assert all(r.n_lines == len(dict(rows)[r.doc_id].split("\n")) and r.n_dropped == len(r.dropped) for r in out)


def test_edges(documents):
    long_ = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "a b c d"), (4, "a b c d"), (5, "a b c d e\n\na b c d e"), (None, "a b c d e f"), (6, long_), (7, long_ + " more"), (8, "x\rone two three four five")]
    out = {r.doc_id: list(r.dropped) for r in linedup.dedup_lines(documents(rows, extra=True)).collect()}
    assert out == {1: [], 2: [], 3: [], 4: [0], 5: [2], None: [0], 6: [], 7: [0], 8: []}
    assert linedup.dedup_lines(documents([])).count() == 0
    twice = linedup.dedup_lines(documents([(1, "a b c d e"), (1, "a b c d e"), (1, "a b c d x")])).collect()
    assert sorted(len(r.dropped) for r in twice) in ([0, 0, 1], [0, 1, 1])


def test_cleaned_documents(documents):
    docs = documents([(1, "one two three four five\nkeep"), (2, "one two three four five"), (3, "one two three four six\nshort"), (4, ""), (5, None)], extra=True)
    out = linedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("one two three four five\nkeep", 28), 3: ("short", 5), 4: ("", 0), 5: (None, 0)}


def test_many_lines_near_one_and_short_repeats(documents):
    rows = [(i, f"a b c d e f g h x{i}\nshort\n\n{'nospaces' * 20}") for i in range(300)]
    out = {r.doc_id: list(r.dropped) for r in linedup.dedup_lines(documents(rows)).collect()}
    assert out == {0: [], **{i: [0, 1, 3] for i in range(1, 300)}}
