import random

from pyspark.sql import functions as F

from tamarack.functions import metrics as M
from tamarack.operators import evaluate


def precision(r, e, k):
    return sum(any(x in s for x in e) for s in r[:k]) / k


def recall(r, e, k):
    e = set(e)
    return sum(any(x in s for s in r[:k]) for x in e) / len(e) if e else 1.0


def mrr(r, e):
    return next((1 / i for i, s in enumerate(r, 1) if any(x in s for x in e)), 0.0)


def test_against_plain_python(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    cases = [([name() for _ in range(rng.randint(0, 12))], [name() for _ in range(rng.randint(0, 4))]) for _ in range(200)]
    cases += [([], ["a"]), (["a"], []), (["xab"], ["a", "a"])]
    df = spark.createDataFrame([(i, r, e) for i, (r, e) in enumerate(cases)], "i int, r array<string>, e array<string>")
    got = evaluate.judge(df, F.col("r"), F.col("e")).withColumn("most", M.recall_at_most(F.col("r"), F.col("e"))).orderBy("i").collect()
    for g, (r, e) in zip(got, cases, strict=True):
        assert abs(g.p5 - precision(r, e, 5)) < 1e-12 and abs(g.r10 - recall(r, e, 10)) < 1e-12 and abs(g.mrr - mrr(r, e)) < 1e-12
        assert abs(g.most - recall(r, e, 10)) < 1e-12


def test_answers(spark):
    rows = [("The LoanService and fines", ["a/LoanService.java", "b/x.py"], "loan fines apply", ["Fine", "zzz"]), ("", [], None, None), ("ab", ["a/abc.py"], "a", [])]
    df = spark.createDataFrame(rows, "answer string, sources array<string>, reference string, keywords array<string>")
    a, b, c = evaluate.answers(df).collect()
    assert (a.faithfulness, round(a.overlap, 4), a.missing) == (1.0, 0.3333, ["zzz"])
    assert (b.faithfulness, b.overlap, b.missing) == (1.0, None, None)
    assert (c.faithfulness, c.overlap, c.missing) == (1.0, 1.0, [])


def test_reports(spark):
    rows = [("x", "q1", 0.2, 0.5, 1.0), ("x", "q2", 0.4, 0.7, 0.5), ("y", "q1", 0.6, 0.5, 0.2), ("y", "q2", 0.2, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "config string, name string, p5 double, r10 double, mrr double")
    means = {r.config: r for r in evaluate.report(df).where("is_mean = 1").collect()}
    assert round(means["x"].r10, 6) == 0.6 and evaluate.report(df).count() == 6
    assert evaluate.best(df).first().config == "y" and evaluate.best(df, "mrr").first().config == "x"
    assert {(r.name, r.x, r.y, round(r.delta, 6)) for r in evaluate.change(df, "x", "y").collect()} == {("q1", 0.5, 0.5, 0.0), ("q2", 0.7, 0.9, 0.2)}
    gates = evaluate.gates(df.groupBy().agg(*(F.avg(c).alias(c) for c in ("p5", "r10", "mrr")))).first()
    assert (gates.p5_ok, gates.r10_ok, gates.mrr_ok) == (True, True, True)
