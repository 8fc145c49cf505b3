import math
import random

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import langid

WORDS = {"en": "the of and that with from this have which their would there", "de": "der die und nicht eine mit auf werden haben schaft zwischen", "fr": "les des une dans pour avec cette être sont aux même", "fi": "että mutta kun niin ovat myös ollut sekä joka hänen kanssa jälkeen ennen"}


def corpus(spark, n=240, langs=("en", "de", "fr")):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = langs[i % len(langs)]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_calibration(spark):
    docs = corpus(spark)
    model = langid.fitted(docs.where("doc_id % 4 <> 1"))
    held = langid.predict(docs.where("doc_id % 4 = 1"), model).collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    assert sum(r.rejected for r in held) <= 0.05 * len(held)


def test_edges(spark):
    model = langid.fitted(corpus(spark))
    rows = [(1, None), (2, ""), (3, "12 !? 45"), (4, "der die das"), (4, "der die das"), (5, "the " * 50_000), (None, "les des aux")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en"), (None, "fr")]
    kept = langid.recognised(docs.withColumn("letters_", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "score", "letters_"]
    assert [r.doc_id for r in kept.collect()] == [4, 4, 5, None]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fitted(docs) is None
    assert langid.predict(docs, None).first().lang_pred == "und"
    assert [r.text for r in langid.recognised(docs.union(docs.selectExpr("2L", "'12'", "lang")), None).collect()] == ["abc"]
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fitted(corpus(spark))).count() == 0


def test_a_language_that_was_not_learned_is_rejected(spark):
    """Learned ones stay, short texts of theirs too."""
    learned = corpus(spark, 6000, ("en", "de", "fr"))
    model = langid.fitted(learned.where("doc_id % 4 <> 1"))
    own = langid.predict(learned.where("doc_id % 4 = 1"), model).collect()
    assert sum(r.rejected for r in own) <= 0.01 * len(own)
    assert not any(r.rejected for r in langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(["der die und", "the of and", "les des une"])], "doc_id long, text string"), model).collect())
    rows = [(i, " ".join(random.Random(i).choices(WORDS["fi"].split(), k=40))) for i in range(200)]
    foreign = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sum(r.rejected for r in foreign) >= 0.9 * len(foreign)


def test_probabilities_are_those_of_the_plain_model():
    """Features one by one, in Python's integers, against the arrays."""
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], rng.normal(0, 2, (1 << langid.BUCKETS_BITS, 3)).astype(np.float32), rng.normal(0, 1, 3), np.zeros(4))
    texts = [b"", b"x", "Über allen Gipfeln ist Ruh".encode(), b"12 & 34", b"The END of\nthe world " * 30]

    def plain(text):
        data = [c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text] + [32]
        logits, count = [0.0] * 3, 0
        for n, seed in zip(langid.GRAMS, langid._SEEDS, strict=True):
            for i in range(len(data)):
                code = sum((data[i + j] if i + j < len(data) else 32) << 8 * j for j in range(n))
                h = ((code * seed & 0xFFFFFFFF) ^ code >> 15) * seed & 0xFFFFFFFF
                row = model.table[h >> 32 - langid.BUCKETS_BITS]
                logits, count = [x + float(y) for x, y in zip(logits, row, strict=True)], count + 1
        e = [math.exp(x / count + b) for x, b in zip(logits, model.bias, strict=True)]
        return [x / sum(e) for x in e]

    assert np.allclose(model.probabilities(texts), [plain(t) for t in texts], atol=1e-4)
