"""Language identification from averaged subword embeddings.

A text's features are its hashed byte n-grams (ASCII letters lower-cased, everything that
is no letter a space). Each hash has an embedding; a text is the mean of its features'
embeddings, and a linear layer with softmax names the language. Both are trained together
by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled texts
(about ``PER_LANGUAGE`` documents a language, ``TOTAL`` in all). Only the model reaches the
driver: for each feature the product of its embedding with the linear layer, a table of
fixed size.

A fifth of the sample is held back. On it the softmax's temperature is set, and the scores
below which a prediction is rejected: as short texts score lower, one for each class of
lengths, with pieces of the texts held back. Languages that weren't learned are met in
advance: models are trained that leave some languages out, and score these. Where their
scores lie below those of nearly all texts that are named rightly, the threshold stands in
the middle; else it is as high as ``REJECTED_RIGHTLY_NAMED`` allows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common, textkit

log = logging.getLogger("tamarack")
GRAMS = (2, 3, 4)
BUCKETS_BITS = 15
DIMENSIONS = 16
#: Documents of the sample: of one language, and of all.
PER_LANGUAGE, TOTAL = 1000, 20_000
#: The most frequent labels, so many, are learned.
LANGUAGES = 500
#: Of texts that are named rightly, at most so many may be rejected.
REJECTED_RIGHTLY_NAMED = 0.002
#: Bytes of the pieces of texts held back, and the greatest lengths of all classes but the last.
PIECES, LENGTHS = (16, 64, 256), (32, 128, 512)
#: Texts of a class of lengths from which its threshold can be told, and models that leave languages out.
ENOUGH, FOLDS = 200, 4
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_SEEDS = (2654435761, 2246822519, 3266489917)


def features(buffer: np.ndarray) -> list[np.ndarray]:
    """For each n in GRAMS, the hashed n-gram that begins at each byte of the folded buffer."""
    x = _FOLD[buffer].astype(np.uint32)
    pad = np.concatenate([x, np.full(max(GRAMS), 32, np.uint32)])
    code = np.zeros(len(x), np.uint32)
    out, at = [], 0
    for n, seed in zip(GRAMS, _SEEDS, strict=True):
        while at < n:
            code = code + (pad[at : at + len(x)] << np.uint32(8 * at))
            at += 1
        out.append(((code * np.uint32(seed)) ^ (code >> np.uint32(15))) * np.uint32(seed) >> np.uint32(32 - BUCKETS_BITS))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # of each feature hash, its part of the logits
    bias: np.ndarray
    thresholds: np.ndarray  # of each class of lengths

    def rejects(self, texts: list[bytes], top: np.ndarray) -> np.ndarray:
        """Whether the texts' best probabilities are too low for their lengths."""
        return top < self.thresholds[np.searchsorted(LENGTHS, [len(t) for t in texts])]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row a text."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in textkit.chunks(texts, 1 << 18):
            lengths = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
            gap = b" " * max(GRAMS)  # no n-gram reaches into the next text
            buffer = np.frombuffer(gap.join([*texts[a:b], b""]), np.uint8)
            begin = np.cumsum(lengths + len(gap) - 1) - lengths - len(gap) + 1
            total = 0
            for f in features(buffer):
                total = total + self.table[f]
            sums = np.add.reduceat(total.astype(np.float64), np.stack([begin, begin + lengths], 1).ravel(), axis=0)[::2]
            out[a:b] = sums / (len(GRAMS) * lengths[:, None]) + self.bias
        return softmax(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> tuple[list[str], DataFrame | None]:
    """Languages, and the labels and features of about per_language documents each.

    Documents are chosen by a hash of doc_id and text, with a rate that their language's
    count sets. Rows: label, held (back), size (bytes), hashes and shares of the features
    of a whole text or, for texts held back, of a piece of it.
    """
    use = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = use.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], None
    most = min(per_language, max(1, total // len(counts)))
    rate = docs.sparkSession.createDataFrame([(r.lang, i, min(1.0, most / r["count"])) for i, r in enumerate(counts)], "lang string, label int, rate double")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    held = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(5)) == 0
    chosen = use.join(F.broadcast(rate), "lang").where(chance < F.col("rate")).select("label", held.alias("held"), "text")

    def count(batches):
        for batch in batches:
            rows = []
            for label, back, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), textkit.as_bytes(batch.column(2)), strict=True):
                for n in (0, *PIECES) if back else (0,):
                    if n and len(text) <= n:
                        continue
                    at = (len(text) - n) // 2 if n else 0
                    part = text[at : at + n] if n else text
                    found, times = np.unique(np.concatenate(features(np.frombuffer(part + b" ", np.uint8))), return_counts=True)
                    rows.append((label, back, len(part), found.astype(np.uint16).tobytes(), (times / times.sum()).astype(np.float32).tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "held", "size", "hashes", "shares"])

    return [r.lang for r in counts], map_in_arrow(chosen, count, "label int, held boolean, size long, hashes binary, shares binary")


Texts = list[tuple[np.ndarray, np.ndarray]]


def descend(k: int, labels: np.ndarray, texts: Texts, epochs: int = 6, rate: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's part of the logits, and the biases, by stochastic gradient descent."""
    rng = np.random.default_rng(5)
    embed = rng.normal(0, 0.1, (1 << BUCKETS_BITS, DIMENSIONS)).astype(np.float32)
    linear = rng.normal(0, 0.3, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            f, share = texts[i]
            mean = share @ embed[f]
            p = softmax((mean @ linear + bias)[None])[0]
            p[labels[i]] -= 1
            grown = linear @ p
            linear -= 0.05 * step / rate * np.outer(mean, p)
            bias -= 0.01 * step / rate * p
            embed[f] -= step * share[:, None] * grown
    return embed @ linear, bias


def scaled(table: np.ndarray, bias: np.ndarray, labels: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The same at the temperature that suits held-back texts best."""
    logits = logits_of(table, bias, texts)

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits * t)[np.arange(len(labels)), labels], 1e-12)).mean() if len(labels) else 0.0

    scale = min(np.geomspace(0.1, 1, 21), key=loss)
    return (table * scale).astype(np.float32), (bias * scale).astype(np.float64)


def logits_of(table: np.ndarray, bias: np.ndarray, texts: Texts) -> np.ndarray:
    return np.array([share @ table[f] + bias for f, share in texts]).reshape(-1, len(bias))


def train(k: int, labels: np.ndarray, held: np.ndarray, sizes: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's table, biases and thresholds."""
    of_class = np.searchsorted(LENGTHS, sizes)
    whole = np.flatnonzero(held & (sizes >= LENGTHS[-1])) if (held & (sizes >= LENGTHS[-1])).sum() >= ENOUGH else np.flatnonzero(held)
    some = lambda rows: [texts[i] for i in rows]

    def model(left_out=()):
        use = ~np.isin(labels, left_out)
        number = np.cumsum(~np.isin(np.arange(k), left_out)) - 1
        fit, back = np.flatnonzero(~held & use), whole[use[whole]]
        m = k - len(left_out)
        return scaled(*descend(m, number[labels[fit]], some(fit)), number[labels[back]], some(back))

    table, bias = model()
    back = np.flatnonzero(held)
    p = softmax(logits_of(table, bias, some(back))) if len(back) else np.zeros((0, k))
    right = p.argmax(1) == labels[back]
    foreign_scores, foreign_class = [], []
    for fold in np.array_split(np.arange(k), min(k, FOLDS)) if k > 2 else ():
        if k - len(fold) < 2:
            continue
        other = np.flatnonzero(held & np.isin(labels, fold))
        if len(other):
            foreign_scores.append(softmax(logits_of(*model(fold), some(other))).max(1))
            foreign_class.append(of_class[other])
    foreign_scores, foreign_class = np.concatenate(foreign_scores or [[]]), np.concatenate(foreign_class or [[]])
    thresholds = np.zeros(len(LENGTHS) + 1)
    for c in range(len(thresholds)):
        own, foreign = p.max(1)[right & (of_class[back] == c)], foreign_scores[foreign_class == c]
        if len(own) < ENOUGH:  # longer texts score higher, so the threshold of shorter ones is safe
            thresholds[c] = thresholds[c - 1] if c else 0.0
            continue
        least = float(np.quantile(own, REJECTED_RIGHTLY_NAMED))
        most = float(np.quantile(foreign, 0.99)) if len(foreign) else least
        thresholds[c] = (least + most) / 2 if most < least else least
    return table, bias, thresholds


def fitted(docs: DataFrame) -> Model | None:
    """A model of the labelled documents; None where there are none."""
    languages, rows = sample(docs)
    if not languages:
        return None
    k = len(languages)

    def fit(batches):
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        label, held, size = (got[c].to_numpy() for c in ("label", "held", "size"))
        hashes, shares = got["hashes"].to_pylist(), got["shares"].to_pylist()
        order = sorted(range(len(label)), key=lambda i: (label[i], hashes[i], shares[i]))  # rows come in any order
        texts = [(np.frombuffer(hashes[i], np.uint16), np.frombuffer(shares[i], np.float32)) for i in order]
        found = train(k, label[order], held[order], size[order], texts)
        yield pa.record_batch([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in found], ["table", "bias", "thresholds"])

    got = map_in_arrow(rows.repartition(1), fit, "table binary, bias binary, thresholds binary").collect()  # one row
    if not got:
        return None
    read = lambda x: np.frombuffer(x, np.float32)
    return Model(languages, read(got[0].table).reshape(-1, k), read(got[0].bias).astype(np.float64), read(got[0].thresholds).astype(np.float64))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text and any other columns) with lang_pred, score and rejected.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has
    no letter, or nothing was learned. rejected: ``und``, or a score below the calibrated
    threshold of its length. Equal scores go to the more frequent language. A text is scored
    whole, in parts of fixed size. Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*keep)
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    given = docs.withColumn("letters_", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def score(batches):
        names = pa.array(model.languages)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = textkit.as_bytes(table["text"].combine_chunks())
            p = model.probabilities(texts)
            best = p.argmax(1)
            has = table["letters_"].to_numpy()
            top = np.where(has, p[np.arange(len(best)), best], 0.0)
            said = pa.array(np.where(has, np.array(model.languages, object)[best], UNKNOWN), names.type)
            out = table.drop_columns(["letters_"]).append_column("lang_pred", said).append_column("score", pa.array(top)).append_column("rejected", pa.array(~has | model.rejects(texts, top)))
            yield from out.combine_chunks().to_batches()

    schema = f"{_ddl(docs)}, lang_pred string, score double, rejected boolean"
    return map_in_arrow(given, score, schema)


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that predict() doesn't reject, with the columns of docs.

    Where nothing was learned, no language can be told apart, so all rows with a letter stay.
    """
    letters = "letters_"
    while letters in docs.columns:
        letters += "_"

    def choose(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = textkit.as_bytes(table["text"].combine_chunks())
            good = table[letters].to_numpy() & ~model.rejects(texts, model.probabilities(texts).max(1))
            yield from table.drop_columns([letters]).filter(pa.array(good)).combine_chunks().to_batches()

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        log.warning("no labels to learn languages from")
        return docs.where(has)
    return map_in_arrow(docs.withColumn(letters, has), choose, _ddl(docs))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents, learned from three of four folds of their labels."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(common.fold(), F.lit(4)) == 2, F.lit(False))
    model = fitted(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
