import math
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import prompt, retrieval
from tamarack.operators.embed import FunctionEmbedder, HashingEmbedder


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "s1", 0, [0.0, 0.0]), ("b", "s1", 1, [0.1, 0.0]), ("c", "s2", 0, [0.1, 0.0]), ("d", None, 0, [0.5, 0.0]), ("e", None, 1, [0.4, 0.0]), ("f", "s3", 0, [2.0, 0.0])]
    return spark.createDataFrame(rows, "id string, source string, chunk_index int, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "query_id long, embedding array<float>")


def ids(df, q=1):
    return [r.id for r in df.where(F.col("query_id") == q).orderBy("rank").collect()]


def test_nearest_and_ties(chunks, queries):
    assert ids(retrieval.nearest(chunks, queries, 4)) == ["a", "b", "c", "e"]
    assert ids(retrieval.nearest(chunks, queries, 99), 2) == ["f", "d", "e", "b", "c", "a"]
    assert [r.id for r in retrieval.nearest_one(chunks, [0.0, 0.0], 3).collect()] == ["a", "b", "c"]


def test_one_chunk_a_source(chunks, queries):
    assert ids(retrieval.nearest_sources(chunks, queries, 1)) == ["a"]
    assert ids(retrieval.nearest_sources(chunks, queries, 2, overfetch=1)) == ["a"]  # the pool is dominated by one source
    assert ids(retrieval.nearest_sources(chunks, queries, 2, exact_distinct=True)) == ["a", "c"]
    assert ids(retrieval.nearest_sources(chunks, queries, 9)) == ["a", "c", "e", "f"]


def test_scores(chunks, queries):
    hits = retrieval.relative_scores(retrieval.nearest(chunks, queries, 6))
    got = {r.id: r.score for r in hits.where("query_id = 1").collect()}
    assert got["a"] == 100 and got["f"] == 0 and 0 < got["d"] < 100
    assert {r.score for r in retrieval.relative_scores(retrieval.nearest(chunks, queries, 1)).collect()} == {100.0}
    same = retrieval.relative_scores(retrieval.nearest(chunks.where("id in ('b', 'c')"), queries, 2))
    assert {r.score for r in same.collect()} == {100.0}
    assert retrieval.relative_scores(retrieval.nearest(chunks.limit(0), queries, 2)).count() == 0
    assert [r.query_id for r in retrieval.far_queries(retrieval.nearest(chunks.where("id = 'f'"), queries, 1), 1.0).collect()] == [1]


def test_metrics_of_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.5])], "a array<double>, b array<double>")
    d = lambda m: df.select(retrieval.distance(F.col("a"), F.col("b"), m).alias("d")).first().d
    assert math.isclose(d("l2sq"), 3.25) and math.isclose(d("ip"), -3.0) and math.isclose(d("cosine"), 1 - 3 / math.sqrt(5 * 4.25))
    with pytest.raises(ValueError):
        d("other")


def test_cells_find_most(spark):
    import random

    rng = random.Random(2)
    rows = [(str(i), [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(10)], "query_id long, embedding array<double>")
    near = {(r.query_id, r.id) for r in retrieval.nearest(chunks, queries, 5).collect()}
    found = {(r.query_id, r.id) for r in retrieval.approximate(chunks, queries, 5, cells=8, probes=5).collect()}
    assert len(near & found) >= 0.85 * len(near)


def test_embedders(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, ""), (3, "beta ALPHA alpha")], "i int, document string")
    a, b, c = (r.embedding for r in HashingEmbedder(16).add(df).orderBy("i").collect())
    assert a == c and math.isclose(sum(x * x for x in a), 1) and b == [0.0] * 16
    out = FunctionEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts], 1).add(df).orderBy("i").collect()
    assert [r.embedding for r in out] == [[16.0], [0.0], [16.0]]


def test_output_forms(spark):
    hits = spark.createDataFrame([(1, 1, "a.py", 0, "x" * 601, 0.25, 99.96), (1, 2, None, None, "y", 0.5, 3.14)], "query_id long, rank int, source string, chunk_index int, document string, distance double, score double")
    first = retrieval.lines(hits.limit(1)).first().line
    assert first == "[01] 100.0%  a.py  (chunk 0)\n" + "-" * 60 + "\n" + "x" * 600 + "..."
    assert retrieval.file_lines(hits.limit(1)).first().line == "[01] 100.0%  a.py"
    assert retrieval.json_rows(hits.limit(1)).first().json == '{"source":"a.py","score":100.0,"distance":0.25}'
    assert prompt.context(hits).first().context == "[Snippet 1 from a.py chunk 0]\n" + "x" * 601 + "\n\n[Snippet 2 from <unknown> chunk ?]\ny"


def test_templates(spark):
    def render(template, question="Q", snippets="S"):
        df = spark.createDataFrame([(template, question, snippets)], "t string, q string, s string")
        return df.select(prompt.chat_prompt(F.col("t"), F.col("q"), F.col("s")).alias("p"), prompt.summary_prompt(F.col("t"), F.col("q")).alias("m")).first()

    assert render("a <<BUG_TEXT>> b <<SNIPPETS>>").p == "a Q b S"
    assert render("a").p == "a\n\nBug description:\nQ\n\nRelevant snippets:\nS"
    assert render("<<BUG_TEXT>>", "see <<SNIPPETS>>").p == "see S"
    assert render("a").m == "a\n\nBug text:\nQ" and render("<<BUG_TEXT>>!").m == "Q!"
    with pytest.raises(ValueError):
        prompt.checked_question("  ")


def test_long_questions_and_token_streams(spark):
    questions = spark.createDataFrame([(1, "short"), (2, "x" * 50)], "query_id long, text string")
    out = prompt.shortened(questions, lambda df: df.withColumn("text", F.lit("summary")), 10)
    assert {(r.query_id, r.text) for r in out.collect()} == {(1, "short"), (2, "summary")}
    parts = spark.createDataFrame([(1, 1, "He", False), (1, 2, None, False), (1, 3, "y", True), (1, 4, "late", False)], "stream_id long, seq int, content string, done boolean")
    assert prompt.token_stream(parts).first().answer == "Hey"
    asked = spark.createDataFrame([("what is alpha", "Alpha is one. Beta is two.")], "question string, context string")
    assert prompt.ExtractiveAnswerer().answer(asked).first().answer == "Alpha is one."


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, "s", [rng.random() for _ in range(4)]) for i in range(60)], "id long, source string, embedding array<double>")
    q = v.where("id % 2 = 0").select(F.col("id").alias("query_id"), "embedding")
    whole = sorted((r.query_id, r.rank, r.id) for r in retrieval.nearest(v, q, 5).collect())
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 16)
    found = retrieval.nearest(v, q, 5)
    assert sorted((r.query_id, r.rank, r.id) for r in found.collect()) == whole
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_streams_that_are_cancelled(spark):
    parts = [{"message": {"content": "a"}}, {"message": {"content": "b"}}, {"message": {}, "done": True}, {"message": {"content": "late"}}]
    heard = []
    assert prompt.emit(parts, heard.append) == ("ab", True) and heard == ["a", "b"]
    assert prompt.emit(parts, is_cancelled=lambda: True) == ("", False)
    messages = spark.createDataFrame([("s", 1, "a", False), ("s", 2, "b", True), ("t", 1, "c", False)], "stream_id string, seq long, content string, done boolean")
    stop = spark.createDataFrame([("s", 1)], "stream_id string, last_seq long")
    assert {(r.stream_id, r.answer, r.finished) for r in prompt.token_stream(messages, stop).collect()} == {("s", "a", False), ("t", "c", False)}


def test_prompts_and_estimates(spark, tmp_path):
    from tamarack import config
    from tamarack.operators import diagnostics

    config.save_prompts(f"{tmp_path}/p.json", {"summarizer": "a", "chat": "b", "other": "c"})
    assert config.load_prompts(f"{tmp_path}/p.json") == {"summarizer": "a", "chat": "b"}
    with pytest.raises(ValueError):
        config.save_prompts(f"{tmp_path}/p.json", {"chat": "b"})
    row = diagnostics.estimate(spark.range(100), 4).first()
    assert (row.files, round(row.fast_seconds, 6), round(row.syntax_seconds, 6)) == (100, 1.5, 9.25)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_recall_of_the_approximate_search(spark, metric):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = []
    for i in range(2000):
        v = [x + 0.4 * rng.gauss(0, 1) for x in rng.choice(centres)]
        length = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / length for x in v]))
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.where("id % 40 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in retrieval.nearest(v, q, 10, metric).collect()}
    found = {(r.query_id, r.id) for r in retrieval.approximate(v, q, 10, metric).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
