import collections
import math
import random
import zlib

import numpy as np

from tamarack.llm import lm

from .brute import fold


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        w = ["alpha"]
        while len(w) < rng.randint(5, 60):
            w.append({"alpha": "beta", "beta": "gamma", "gamma": rng.choice(["alpha", "delta"]), "delta": "alpha"}.get(w[-1], "alpha") if rng.random() < 0.9 else f"rare{rng.randint(0, 400)}")
        rows.append((i, " ".join(w).title()))
    return rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def test_base_scores_and_better_model(documents, monkeypatch):
    monkeypatch.setattr(lm, "NEAR", 50)  # so that most words' counts are joined
    rows = corpus() + [(1000, None), (1001, ""), (None, "alpha beta"), (3000, "unseen1 unseen2 alpha"), (3001, "x " * 20_000)]
    counts = collections.Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*fold(t), None])
    n, v = sum(counts.values()), len(counts)
    out = lm.score(documents(rows, extra=True)).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        w = [*fold(texts[r.doc_id]), None]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(counts[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    test = [r for r in out if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_probabilities_of_all_classes_sum_to_one():
    rng = np.random.default_rng(1)
    layout = lm.Layout(rng.dirichlet(np.ones(lm.CLASSES)))
    trainer = lm.Trainer(lm.initial(layout), layout, 1)
    tokens = rng.choice(lm.CLASSES, 3000, p=layout.shares)
    for i in range(0, 3000, 500):
        trainer.step(layout.place[tokens[i : i + 500]], layout.place[np.stack([np.roll(tokens, k)[i : i + 500] for k in (1, 2, 3)])])
    model = lm.Scorer(trainer.now, layout)
    for context in ([5, 9, 700], [lm.END] * 3, [lm.HEAD + 1, lm.CLASSES - 2, 0]):
        every = model(np.arange(lm.CLASSES), np.repeat(np.array(context)[:, None], lm.CLASSES, 1))
        assert math.isclose(np.exp(every).sum(), 1.0, rel_tol=1e-5)


def test_probabilities_are_those_of_the_whole_softmax():
    """The scorer's batches against one token at a time."""
    rng = np.random.default_rng(2)
    layout = lm.Layout(rng.dirichlet(np.ones(lm.CLASSES) * 0.5))
    embed, out, top, scale = (rng.normal(0, 0.5, p.shape).astype(np.float32) for p in lm.initial(layout))
    token, before = rng.integers(0, lm.CLASSES, 40), rng.integers(0, lm.CLASSES, (3, 40))
    got = lm.Scorer([embed, out, top, scale], layout)(token, before, 7)
    for i in range(40):
        h = sum(scale[k] * embed[layout.place[before[k, i]]] for k in range(3)).astype(np.float64)
        place, g = layout.place[token[i]], layout.of[layout.place[token[i]]]
        members = np.flatnonzero(layout.of == g)
        groups = top[:, :-1] @ h + top[:, -1]
        inner = out[members, :-1] @ h + out[members, -1]
        want = groups[g] - np.log(np.exp(groups).sum()) + (out[place, :-1] @ h + out[place, -1]) - np.log(np.exp(inner).sum())
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_untrained_parameters_give_the_shares():
    layout = lm.Layout(np.random.default_rng(3).dirichlet(np.ones(lm.CLASSES)))
    flat = lm.initial(layout)
    token = np.arange(0, lm.CLASSES, 37)
    assert np.allclose(lm.Scorer(flat, layout)(token, np.zeros((3, len(token)), int)), np.log(layout.shares[token]), atol=1e-4)


def test_words_that_share_a_class_are_scored_by_their_contexts_too(documents, monkeypatch):
    """With few classes of their own, most words share one; the model still beats the shares."""
    monkeypatch.setattr(lm, "NEAR", 20)
    rng, rows = random.Random(6), []
    for i in range(600):
        a = rng.randint(0, 40)
        rows.append((i, " ".join(f"{'ab'[j % 2]}{(a + j) % 40}" for j in range(40))))
    out = [r for r in lm.score(documents(rows)).collect() if r.held_out]
    assert out and sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_without_training_texts(documents, spark):
    only = next(i for i in range(100) if held(i))
    out = lm.score(documents([(only, "a b"), (only, "a b")])).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in out] == [(True, 0, 0, 0.0)] * 2
    assert lm.score(documents([])).count() == 0
