"""Many queries go in blocks of both sides, with the same results as all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluate, pairs, retrieval


def distance(a, b, metric):
    """Of two lists as SQL has it: null and missing components are left out."""
    of = lambda x, y: [(p, q) for p, q in zip(x or [], y or []) if p is not None and q is not None]
    both = of(a, b)
    if not both:
        return None
    total = 0.0
    for p, q in both:
        total += (p - q) * (p - q) if metric == "l2sq" else p * q
    if metric == "cosine":
        length = math.prod(math.sqrt(sum(p * p for p, _ in of(x, x))) for x in (a, b))
        return 1 - total / length if length else math.nan if not total else -math.copysign(math.inf, total)
    return -total if metric == "ip" else total


def order(hit):
    d = hit[1]
    return (d is None, d is not None and math.isnan(d), 0 if d is None or math.isnan(d) else d, hit[0])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(5)] for _ in range(160)]  # many ties
    out += [[rng.gauss(0, 1) for _ in range(5)] for _ in range(80)] + [[1.0, 0.0, 0.5, 0.25, 0.0]] * 60
    out += [None, [0.0] * 5, [], [1.0, None, 0.5, 0.0, 0.0], [0.5, 1.0], [math.nan] + [1.0] * 4, [1e60] * 5, None, [None] * 5, [1e-200] * 5]
    rng.shuffle(out)
    return [(i, None if i % 11 == 3 else f"s{i % 7}", v) for i, v in enumerate(out)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 400)
    monkeypatch.setattr(pairs, "DISTANCES", 300)


def tables(spark, rows, every=3):
    chunks = spark.createDataFrame(rows, "id long, source string, embedding array<double>")
    return chunks, chunks.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding")


def close(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15)))


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_nearest_of_all_pairs(spark, small, rows, metric):
    found = retrieval.nearest(*tables(spark, rows), 7, metric)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    for q, _, v in rows[::3]:
        want = sorted(((i, distance(w, v, metric)) for i, _, w in rows), key=order)[:7]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and all(close(x, y) for (_, x), (_, y) in zip(got[q], want, strict=True)), q


def test_nearest_of_each_source(spark, small, rows):
    found = retrieval.nearest_sources(*tables(spark, rows), 4, exact_distinct=True)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.source or "", r.id))
    for q, _, v in rows[::3]:
        best = {}
        for i, s, w in rows:
            best.setdefault(s or "", []).append((i, distance(w, v, "l2sq")))
        want = sorted(((*min(hits, key=order), s) for s, hits in best.items()), key=order)[:4]
        assert got[q] == [(s, i) for i, _, s in want], q


@pytest.mark.parametrize("k", [1, 5])
def test_sweep_of_all_pairs(spark, small, rows, k):
    good = [(i, s, v) for i, s, v in rows if v and len(v) == 5 and None not in v and 1e-9 < sum(map(abs, v)) < 1e9]
    whole, asked = tables(spark, good, 6)
    asked = asked.withColumn("expected", F.array(F.concat(F.lit("s"), (F.col("query_id") % 7).cast("string"))))
    files = whole.select(F.col("id").alias("file_path"), F.coalesce("source", F.lit("")).alias("source"), (F.col("id") % 5 / 4).alias("lev"), (F.col("id") % 3).cast("double").alias("path_distance"), "embedding")
    met = files.crossJoin(asked.withColumnRenamed("embedding", "q")).withColumn("cos_norm", 1 - retrieval.distance(F.col("embedding"), F.col("q"), "cosine"))
    plain = lambda df: sorted((r.alpha, r.beta, round(r.r10, 9), r.best) for r in df.collect())
    weights = ([0.0, 0.3, 1.0], [0.3, 0.9])
    found = evaluate.sweep_vectors(files, asked, *weights, k)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert plain(found) == plain(evaluate.sweep(met, *weights, k))


def test_only_the_first_copies_stay(spark):
    import numpy as np

    x = np.array([[1.0, 2.0]] * 5 + [[2.0, 1.0]] * 2 + [[1.0, 2.0]])
    there = np.ones(x.shape, bool)
    assert pairs.firsts(pairs.Rows(x, there), 2).tolist() == [0, 1, 5, 6]
    assert pairs.firsts(pairs.Rows(x, there), 1, np.arange(8) % 2).tolist() == [0, 1, 5, 6]


def test_no_vectors(spark, rows):
    chunks, asked = tables(spark, rows)
    assert retrieval.nearest(chunks.limit(0), asked, 3).count() == 0
    assert retrieval.nearest(chunks, asked.limit(0), 3).count() == 0


def test_cells_of_one_side():
    import pyarrow as pa

    rows = pa.table({"id": [1, 2], "embedding": pa.array([[1.0], [2.0]])})
    asked = pa.table({"query_id": [1], "query_embedding": pa.array([[1.0]])})
    for a, b in ((asked.slice(0, 0), rows), (asked, rows.slice(0, 0))):
        assert [len(x) for x in pairs.best(a, b, 3, "l2sq", "id", None)[1:]] == [0, 0, 0]
        assert [len(x) for x in pairs.swept(a, b, [(0.3, 0.6)], 3, "id")[1:]] == [0, 0, 0, 0]


def test_hashed_tokens_are_counted_once_in_batches(spark, monkeypatch):
    import hashlib

    from tamarack.operators.embed import HashingEmbedder

    monkeypatch.setattr(HashingEmbedder, "KNOWN", 2)
    texts = ["Alpha beta_1 alpha, gamma", "", None, "ÄÖ -- ", "x y z x İ K"]
    found = HashingEmbedder(16).add(spark.createDataFrame(list(enumerate(texts)), "i int, document string"))
    assert "array_remove" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = [["alpha", "beta_1", "alpha", "gamma"], [], [], [], ["x", "y", "z", "x", "i", "k"]]
    for r in found.collect():
        counts = [0] * 16
        for w in words[r.i]:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        length = math.sqrt(sum(c * c for c in counts))
        assert r.embedding == [c / length if length else 0.0 for c in counts]


def cell(vectors, asked):
    import pyarrow as pa

    rows = pa.table({"id": list(range(len(vectors))), "source": [f"s{i % 6}" for i in range(len(vectors))], "embedding": pa.array(vectors, pa.list_(pa.float64()))})
    return pa.table({"query_id": asked, "query_embedding": rows["embedding"].take(pa.array(asked))}), rows


def one_by_one(a, b, metric):
    """distance, but lengths are summed without the compensation of sum()."""
    if metric != "cosine" or distance(a, b, "ip") is None:
        return distance(a, b, metric)
    length = math.sqrt(-distance(a, a, "ip")) * math.sqrt(-distance(b, b, "ip"))
    return 1 + distance(a, b, "ip") / length if length else math.nan


def check_cell(vectors, asked, n, metric, by):
    a, b = cell(vectors, asked)
    found, row, column, value = pairs.best(a, b, n, metric, "id", by)
    got = {}
    for r, c, d in zip(row.tolist(), found["id"].take(column).to_pylist(), value.to_pylist(), strict=True):
        got.setdefault(r, []).append((c, d))
    for r, q in enumerate(asked):
        want = sorted(((i, one_by_one(v, vectors[q], metric)) for i, v in enumerate(vectors)), key=order)
        if by:
            firsts = {}
            for h in want:
                firsts.setdefault(h[0] % 6, h)
            want = list(firsts.values())
        assert [i for i, _ in sorted(got[r], key=order)[:n]] == [i for i, _ in want[:n]], (r, metric, by)
    return got


@pytest.mark.parametrize("by", [None, "source"])
@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("size", [1.0, 1e40, 1e-40])
def test_plain_vectors_need_no_product_in_doubles(monkeypatch, metric, by, size):
    monkeypatch.setattr(pairs, "TILE", 96)
    monkeypatch.setattr(pairs, "ASKED", 7)

    def refuse(*_):
        raise AssertionError("a product in doubles")

    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) * size for _ in range(12)] for _ in range(900)]
    with monkeypatch.context() as m:
        m.setattr(pairs.Near, "block", refuse)
        check_cell(vectors, list(range(0, 900, 40)), 5, metric, by)
    vectors[::50] = [None, [math.nan] * 12, [0.0] * 12] * 6  # and with rows that aren't plain
    check_cell(vectors, list(range(0, 900, 25)), 5, metric, by)


@pytest.mark.parametrize("by", [None, "source"])
@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_differences_below_single_precision(monkeypatch, metric, by):
    monkeypatch.setattr(pairs, "TILE", 96)
    doubles, block = [], pairs.Near.block
    monkeypatch.setattr(pairs.Near, "block", lambda self, rows: doubles.extend(rows) or block(self, rows))
    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(400)]
    vectors += [[x + rng.gauss(0, 1) * 1e-9 for x in vectors[3]] for _ in range(300)] + [[x * (1 + rng.random() * 1e-8) for x in vectors[5]] for _ in range(40)]
    asked = [3, 5, 7, *range(400, 740, 20)]
    check_cell(vectors, asked, 5, metric, by)
    assert metric != "l2sq" or {i for i, q in enumerate(asked) if q == 3 or 400 <= q < 700} <= set(doubles)  # too many in single precision
