"""Language-model scores of whole texts.

The model is log-bilinear: the three words before a word each have an embedding, scaled for
their place and summed to the context's vector. Every word belongs to one of ``CLASSES``
classes: the ``HEAD`` most frequent words have one each, all others share the rest by their
hash. Classes are dealt, most frequent first, over ``GROUPS`` groups of about equal mass.
The context's product with a group's output embedding, plus a bias, is the group's logit,
and with a class's embedding the class's logit within its group; within a shared class
words have their smoothed shares. So each token's probability is normalised exactly, at the
cost of one group's classes and not of all, and the model is a proper distribution over all
texts.

It is trained in numpy by noise-contrastive estimation, over every token of all training
texts: noise groups are drawn by their shares, noise classes by theirs within the true
group. Each task goes through its texts and gives the rows it changed; rows are averaged
over tasks by how often each changed them, in the plan, and go out again for the next
round. Training thus grows with the corpus, and nothing but the classes' parameters (a
fixed size) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common, textkit

U = textkit.U
HEAD, SHARED = 6143, 2048
END = HEAD + SHARED
CLASSES = END + 1
GROUPS = 96
#: Most frequent words whose counts go to every task; the counts of others are joined.
NEAR = 1 << 17
SMOOTH = 0.1
BEFORE, DIMENSIONS, BATCH, ROUNDS = 3, 24, 4096, 1
#: Noise groups of a batch, and noise classes of each group in it.
NOISE, NOISE_EACH = 24, 2
RATE = 0.1
END_HASH = 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), c: of every word and the end in texts (text)."""

    def make(batches):
        for batch in batches:
            found = []
            for a, b in textkit.chunks(textkit.as_bytes(batch.column(0))):
                words = textkit.Words(textkit.as_bytes(batch.column(0)[a:b]))
                found.append(np.unique(np.append(words.hash.view(np.int64), np.full(b - a, END_HASH)), return_counts=True))
            keys, counts = np.concatenate([x for x, _ in found] or [[]]), np.concatenate([n for _, n in found] or [[]])
            keys, where = np.unique(keys.astype(np.int64), return_inverse=True)
            yield pa.record_batch([pa.array(keys), pa.array(np.bincount(where, counts, len(keys)).astype(np.int64))], ["word", "c"])

    return map_in_arrow(texts.select("text"), make, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lookup:
    """Index of word hashes among the most frequent words, -1 for others."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def classes(rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The class of each word, by its rank and hash."""
    return np.where((rank >= 0) & (rank < HEAD), rank, HEAD + (hashes.view(U) % U(SHARED)).astype(np.int64))


def _sequence(words: textkit.Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, classes before: a row for each place) of all tokens, each text's end included."""
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    token = np.full(len(text), END)
    inner = np.ones(len(text), bool)
    inner[last] = False
    token[inner] = of
    place = np.arange(len(text)) - np.repeat(last - n, n + 1)
    return text, token, np.stack([np.where(place >= k, np.roll(token, k), END) for k in range(1, BEFORE + 1)])


@dataclass(frozen=True)
class Layout:
    """Where classes stand: order, most frequent first; first: each group's first place there.

    place and group: of each class. Their shares are the noise.
    """

    shares: np.ndarray

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        order = np.argsort(-self.shares, kind="stable")
        mass = np.cumsum(self.shares[order])
        group = np.minimum((GROUPS * (mass - self.shares[order] / 2) / mass[-1]).astype(np.int64), GROUPS - 1)
        used, group = np.unique(group, return_inverse=True)
        place = np.empty(CLASSES, np.int64)
        place[order] = np.arange(CLASSES)
        put("place", place)
        put("first", np.append(np.searchsorted(group, np.arange(len(used))), CLASSES))
        put("of", group)  # of each place
        put("heap", np.append(0.0, mass))
        put("mass", np.diff(self.heap[self.first]))
        put("within", np.diff(self.heap) / self.mass[group])
        put("against", np.log(NOISE_EACH * self.within).astype(np.float32))
        put("against_group", np.log(NOISE * self.mass / self.mass.sum()).astype(np.float32))
        put("noise", np.cumsum(self.mass) / self.mass.sum())

    @property
    def groups(self) -> int:
        return len(self.mass)


#: Parts of the parameters: context embeddings, class and group outputs (with bias in the last column), and places' scales.
EMBED, CLASS, GROUP, SCALE = range(4)


def initial(layout: Layout) -> list[np.ndarray]:
    """Parameters under which each class has its share, whatever the context. Rows of EMBED and CLASS are places."""
    rng = np.random.default_rng(3)
    with_bias = lambda p: np.concatenate([np.zeros((len(p), DIMENSIONS)), np.log(p)[:, None]], 1).astype(np.float32)
    scale = np.repeat(np.array([[1.0], [0.6], [0.4]])[:BEFORE], DIMENSIONS, 1)
    return [rng.normal(0, 0.3, (CLASSES, DIMENSIONS)).astype(np.float32), with_bias(layout.within), with_bias(layout.mass), scale.astype(np.float32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation by AdaGrad, batch by batch, on a copy of some parameters."""

    def __init__(self, parameters: list[np.ndarray], layout: Layout, seed: int):
        self.now, self.layout = [p.copy() for p in parameters], layout
        self.sums = [np.full(len(p), 1e-4, np.float32) for p in parameters]
        self.times = [np.zeros(len(p), np.float32) for p in parameters]
        self.rng = np.random.default_rng(seed)

    def _move(self, which: int, rows: np.ndarray, grads: np.ndarray, times) -> None:
        """Subtract the gradients of distinct rows, and count how often each was met."""
        sums = self.sums[which][rows] + np.einsum("ij,ij->i", grads, grads) / grads.shape[1]
        self.sums[which][rows] = sums
        self.now[which][rows] -= grads * (RATE / np.sqrt(sums))[:, None]
        self.times[which][rows] += times

    def step(self, place: np.ndarray, before: np.ndarray) -> None:
        """One batch: each token's place, and the places before it."""
        L, m = self.layout, len(place)
        embed, out, top, scale = self.now
        # In the order of places, tokens of a class, and of a group, are neighbours.
        order = np.argsort(place.astype(np.uint16), kind="stable")  # sixteen bits are sorted by radix
        place, before = place[order], before[:, order]
        starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        lengths = lambda at: np.diff(np.append(at, m)).astype(np.float32)
        parts = embed[before]
        ones = np.ones((m, DIMENSIONS + 1), np.float32)
        context = ones[:, :-1]
        np.einsum("kij,kj->ij", parts, scale, out=context)
        # Groups: noise shared by the batch.
        group = L.of[place]
        noise = np.minimum(np.searchsorted(L.noise, self.rng.random(NOISE)), L.groups - 1)
        tops = top[group]
        g_own = _sigmoid(np.einsum("ij,ij->i", ones, tops) - L.against_group[group]) - 1
        g_others = _sigmoid(ones @ top[noise].T - L.against_group[noise])
        grown = g_own[:, None] * tops[:, :-1] + g_others @ top[noise, :-1]
        at_group = starts(group)
        used = group[at_group]
        grads = np.zeros((L.groups, DIMENSIONS + 1), np.float32)
        grads[used] = np.add.reduceat(g_own[:, None] * ones, at_group, axis=0)
        np.add.at(grads, noise, g_others.T @ ones)
        met = np.unique(np.append(used, noise))
        self._move(GROUP, met, grads[met] / 64, np.bincount(group, minlength=L.groups)[met] + 1)
        # Classes: noise shared by the tokens of a group, drawn from the group.
        low, high = L.heap[L.first[used]][:, None], L.heap[L.first[used + 1]][:, None]
        other = np.searchsorted(L.heap, low + (high - low) * self.rng.random((len(used), NOISE_EACH)), side="right") - 1
        other = np.clip(other, L.first[used][:, None], L.first[used + 1][:, None] - 1)
        of = np.repeat(np.arange(len(used)), np.diff(np.append(at_group, m)))
        own, rest = out[place], out[other]
        g_own = _sigmoid(np.einsum("ij,ij->i", ones, own) - L.against[place]) - 1
        grown += g_own[:, None] * own[:, :-1]
        g_rest = np.empty((m, NOISE_EACH), np.float32)
        for j in range(NOISE_EACH):
            row = rest[:, j][of]
            g_rest[:, j] = g = _sigmoid(np.einsum("ij,ij->i", ones, row) - L.against[other[:, j]][of])
            grown += g[:, None] * row[:, :-1]
        at_class = starts(place)
        mine = np.add.reduceat(g_own[:, None] * ones, at_class, axis=0)
        others = np.stack([np.add.reduceat(g_rest[:, j, None] * ones, at_group, axis=0) for j in range(NOISE_EACH)], 1)
        self._sum_and_move(CLASS, np.append(place[at_class], other), np.append(mine, others.reshape(-1, DIMENSIONS + 1), 0) / 64, np.append(lengths(at_class), np.ones(other.size, np.float32)))
        self._sum_and_move(EMBED, before.ravel(), (grown * (scale / 64)[:, None]).reshape(-1, DIMENSIONS), np.ones(before.size, np.float32))
        self._move(SCALE, np.arange(BEFORE), np.einsum("kij,ij->kj", parts, grown) / m, m)

    def _sum_and_move(self, which: int, rows: np.ndarray, grads: np.ndarray, times: np.ndarray) -> None:
        """_move for rows that may be there several times."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        self._move(which, rows[at], np.add.reduceat(grads[order], at, axis=0), np.add.reduceat(times[order], at))

    def changed(self) -> pa.RecordBatch:
        """which, row, times, v0, v1, ...: the rows that a batch changed."""
        which, row, times, values = [], [], [], []
        for i, (p, t) in enumerate(zip(self.now, self.times, strict=True)):
            at = np.flatnonzero(t)
            which.append(np.full(len(at), i, np.int32))
            row.append(at.astype(np.int32))
            times.append(t[at])
            values.append(np.pad(p[at], ((0, 0), (0, DIMENSIONS + 1 - p.shape[1]))))
        values = np.concatenate(values)
        return pa.record_batch([pa.array(np.concatenate(which)), pa.array(np.concatenate(row)), pa.array(np.concatenate(times)), *(pa.array(np.ascontiguousarray(values[:, j])) for j in range(DIMENSIONS + 1))], ["which", "row", "times", *_V])


_V = [f"v{j}" for j in range(DIMENSIONS + 1)]


def train(texts: DataFrame, head: np.ndarray, layout: Layout, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Parameters trained on every token of texts (text).

    A round is one pass over all texts, side by side; rows are averaged after it.
    """
    parameters = initial(layout)
    for turn in range(rounds):
        given = parameters

        def fit(batches, given=given, turn=turn):
            find, trainer, rest = Lookup(head), Trainer(given, layout, 1000 * turn + TaskContext.get().partitionId()), None
            for batch in batches:
                texts_ = textkit.as_bytes(batch.column(0))
                for a, b in textkit.chunks(texts_):
                    words = textkit.Words(texts_[a:b])
                    hashes = words.hash.view(np.int64)
                    _, token, before = _sequence(words, classes(find(hashes), hashes))
                    # The order of a chunk's tokens is mixed, so that a batch isn't one text.
                    order = trainer.rng.permutation(len(token))
                    place, before = layout.place[token][order], layout.place[before][:, order]
                    if rest is not None:
                        place, before = np.append(rest[0], place), np.append(rest[1], before, 1)
                    whole = len(place) // BATCH * BATCH
                    for i in range(0, whole, BATCH):
                        trainer.step(place[i : i + BATCH], before[:, i : i + BATCH])
                    rest = place[whole:], before[:, whole:]
            if rest is not None:
                if len(rest[0]):
                    trainer.step(*rest)
                yield trainer.changed()

        types = ", ".join(["which int", "row int", "times float", *(f"{v} float" for v in _V)])
        mean = [(F.sum(F.col(v) * F.col("times").cast("double")) / F.sum(F.col("times").cast("double"))).cast("float").alias(v) for v in _V]
        got = map_in_arrow(texts.select("text"), fit, types).groupBy("which", "row").agg(*mean).toArrow()  # one row a parameter row
        parameters = [p.copy() for p in parameters]
        which, row = got["which"].to_numpy(), got["row"].to_numpy()
        values = np.stack([got[v].to_numpy() for v in _V], 1)
        for i, p in enumerate(parameters):
            p[row[which == i]] = values[which == i][:, : p.shape[1]]
    return parameters


class Scorer:
    """Normalised log-probabilities of classes in their contexts."""

    def __init__(self, parameters: list[np.ndarray], layout: Layout):
        self.layout = layout
        self.embed, self.out, self.top, self.scale = parameters

    @staticmethod
    def _log_shares(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Of each row, the logarithm of the chosen one's share after exp; logits are overwritten."""
        if logits.max() > 60:  # else no sum can overflow
            logits -= logits.max(1, keepdims=True)
        own = logits[np.arange(len(logits)), chosen]
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(logits.shape[1], np.float32))

    def __call__(self, token: np.ndarray, before: np.ndarray, size: int = 16_384) -> np.ndarray:
        """Natural logarithms; token and before are classes."""
        L, out = self.layout, np.zeros(len(token))
        for a in range(0, len(token), size):
            place = L.place[token[a : a + size]]
            context = sum(self.scale[k] * self.embed[L.place[before[k, a : a + size]]] for k in range(BEFORE))
            group = L.of[place]
            order = np.argsort(group.astype(np.uint8), kind="stable")
            group, place, context = group[order], place[order], context[order]
            context = np.append(context, np.ones((len(context), 1), np.float32), 1)
            got = self._log_shares(context @ self.top.T, group).astype(np.float64)
            at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                lo, hi = L.first[group[i]], L.first[group[i] + 1]
                for x in range(i, j, step := max(1, (1 << 21) // (hi - lo))):
                    y = min(j, x + step)
                    got[x:y] += self._log_shares(context[x:y] @ self.out[lo:hi].T, place[x:y] - lo)
            out[a + order] = got
        return out


def score(docs: DataFrame, training=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    training: a condition on docs that picks the texts to learn from; by default those whose
    crc32(doc_id as text) mod 10 is not 0; held_out is its contrary. A null text is empty and
    has the end as its only token; rows with a null doc_id are learned from. Without any
    training text every base share is 1 and the model knows smoothed shares only. Very long
    texts are whole in one task, their tokens' probabilities in parts of fixed size.
    Repeated rows are scored alike; other columns are left alone.
    """
    held = F.lit(False) | (F.pmod(common.fold(), F.lit(10)) == 0) if training is None else ~training
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    learned = rows.where("not held_out")
    counts = common.written(word_counts(learned), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END_HASH, F.col("c"))), F.lit(0)).alias("end")).first()
    near = counts.where(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(NEAR).toArrow()  # NEAR rows at most
    words, c = near["word"].to_numpy().astype(np.int64), near["c"].to_numpy().astype(np.int64)
    head = words[:HEAD]
    base_all = total.n + SMOOTH * (total.v + 1)
    # Of each shared class: tokens, words. Those of the most frequent words are taken off again.
    slot = F.pmod(F.col("word"), F.lit(SHARED))
    sums = counts.where(F.col("word") != END_HASH).groupBy(slot.alias("slot")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # SHARED rows at most
    n_, v_ = np.zeros(SHARED), np.zeros(SHARED)
    n_[sums["slot"].to_numpy()], v_[sums["slot"].to_numpy()] = sums["n"].to_numpy(), sums["v"].to_numpy()
    mine = (head.view(U) % U(SHARED)).astype(np.int64)
    n_ -= np.bincount(mine, c[:HEAD], SHARED)
    v_ -= np.bincount(mine, minlength=SHARED)
    shares = np.full(CLASSES, SMOOTH)
    shares[: len(head)] += c[:HEAD]
    shares[HEAD:END] += n_
    shares[END] += total.end
    layout = Layout(shares / shares.sum())
    parameters = train(learned, head, layout)
    base_near, near_log = np.log10((c + SMOOTH) / base_all), np.log10(c + SMOOTH)
    slot_log = np.log10(n_ + SMOOTH * (v_ + 1))
    base_end, ten, known_end = float(np.log10((total.end + SMOOTH) / base_all)), np.log(10), int(total.end > 0)

    def judge(batches):
        find, model = Lookup(words), Scorer(parameters, layout)
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = textkit.as_bytes(batch.column(1))
            for a, b in textkit.chunks(texts):
                w = textkit.Words(texts[a:b])
                m = b - a
                hashes = w.hash.view(np.int64)
                rank = find(hashes)
                of = classes(rank, hashes)
                text, token, before = _sequence(w, of)
                own = np.bincount(text, model(token, before), m) / ten
                there = rank >= 0
                base = base_end + np.bincount(w.text[there], base_near[rank[there]], m)
                shared = of >= HEAD
                own -= np.bincount(w.text[shared], slot_log[of[shared] - HEAD], m)
                rare = there & shared
                own += np.bincount(w.text[rare], near_log[rank[rare]], m)
                known = known_end + np.bincount(w.text[there], minlength=m)
                far = np.flatnonzero(~there)
                order = far[np.lexsort((hashes[far], w.text[far]))]
                t, h = w.text[order], hashes[order]
                new = np.ones(len(order), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(order)))
                at = np.append(0, np.cumsum(np.bincount(t[new], minlength=m))).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(np.arange(serial, serial + m)), batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(w.first) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own), pa.ListArray.from_arrays(at, pa.array(h[new])), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "times"],
                )
                serial += m

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = common.written(map_in_arrow(rows, judge, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, times array<int>"), "scored")
    far = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    c_ = F.coalesce("c", F.lit(0)) + SMOOTH
    more = far.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_far"),
        F.sum(F.col("times") * F.log10(c_ / base_all)).alias("base_far"),
        F.sum(F.col("times") * F.log10(c_)).alias("model_far"),
    )
    both = first.drop("words", "times").join(common.written(more, "far"), "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", plus("known", "known_far").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"), plus("base", "base_far").alias("base_score"), plus("model", "model_far").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents, learned from nine of ten folds."""
    return score(common.table(spark, sf_dir, "documents"))
