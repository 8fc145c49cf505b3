import random

import pytest

from tamarack.operators import fusion, graph


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "IMPORTS", float(w)) for a, b, w in rows], graph.EDGES)


def files(spark, rows):
    return spark.createDataFrame([(p, float(d), s) for p, d, s in rows], "file_path string, cos_distance double, content_snippet string")


def paths(spark, rows, seeds, hops=3, cost="weight"):
    s = spark.createDataFrame([(x,) for x in seeds], "node string")
    return {r.node: round(r.distance, 6) for r in graph.bounded_paths(edges(spark, rows), s, hops, cost).collect()}


def test_bounded_paths(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 0.7), ("d", "e", 1), ("a", "a", 1), ("z", "d", 0.7), ("q", "r", 1)]
    assert paths(spark, rows, ["a"]) == {"a": 0, "b": 1, "c": 2, "d": 2.7}
    assert paths(spark, rows, ["a", "z"]) == {"a": 0, "z": 0, "b": 1, "c": 2, "d": 0.7, "e": 1.7}
    assert paths(spark, rows, ["a"], 1) == {"a": 0, "b": 1} and paths(spark, rows, ["none"]) == {"none": 0}
    assert paths(spark, rows, ["a"], 3, "unit")["d"] == 3 and paths(spark, rows, ["a"], 3, "inverse")["d"] == round(2 + 1 / 0.7, 6)
    # A cheaper path with more hops must not hide one that still has hops left.
    assert paths(spark, [("s", "x", 5), ("s", "t", 1), ("t", "x", 1), ("x", "y", 1), ("y", "z", 1)], ["s"]) == {"s": 0, "t": 1, "x": 2, "y": 3, "z": 7}


def test_ratio():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert fusion.lcs(a, b) == slow(a, b)
    assert fusion.indel_ratio("", "") == 1 and fusion.indel_ratio("a", "") == 0 and fusion.indel_ratio(None, "a") == 0


def test_fusion(spark):
    known = files(spark, [("a", 0.1, "query words"), ("b", 0.4, "other"), ("c", 0.3, "query"), ("far", 0.0, "x")])
    seeds = known.where("file_path = 'a'")
    links = edges(spark, [("a", "b", 1), ("b", "c", 0.7), ("c", "a", 1), ("b", "unknown", 1), ("x", "far", 1)])
    got = {r.file_path: r for r in fusion.expand_and_rerank(seeds, "query words", links, known, 0.3, 0.6, 3).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].source == "vector" and got["b"].source == "graph" and got["a"].lev == 1.0
    for r in got.values():
        assert abs(r.score - 0.6**r.path_distance * (0.3 * r.cos_norm + 0.7 * r.lev)) < 1e-12
    order = [r.file_path for r in fusion.expand_and_rerank(seeds, "query words", links, known).collect()]
    assert order[0] == "a"
    assert [r.file_path for r in fusion.expand_and_rerank(seeds, "q", links, known, beta=0).collect()] == ["a"]
    assert fusion.expand_and_rerank(seeds.limit(0), "q", links, known).count() == 0
    one = fusion.expand_and_rerank(seeds, "q", links, known, alpha=1.0).collect()
    assert all(abs(r.score - 0.6**r.path_distance * r.cos_norm) < 1e-12 for r in one)
    none = fusion.expand_and_rerank(seeds, "query words", links, known, alpha=0.0).collect()
    assert all(abs(r.score - 0.6**r.path_distance * r.lev) < 1e-12 for r in none)
    lone = fusion.expand_and_rerank(seeds, "q", links.limit(0), known)
    assert [r.file_path for r in lone.collect()] == ["a"]
    with pytest.raises(ValueError):
        fusion.expand_and_rerank(seeds, "q", links, known, alpha=2)


def test_fall_back(spark):
    seeds = files(spark, [("a", 0.1, "q")])

    def broken():
        raise OSError("no such table")

    for load in (broken, lambda: None):
        out = fusion.expand_or_fall_back(seeds, "q", load, seeds)
        assert out.columns == ["file_path", "score", "cos_norm", "lev", "path_distance", "source"]
        assert [(r.file_path, r.source) for r in out.collect()] == [("a", "vector")]


def test_extraction_and_replacement(spark):
    java = "package p;\nimport a.b.Loan;\nimport static a.Util.go;\npublic class Desk extends Base<Loan> implements Open, Shut {\n  private final Repo repo;\n  void f() { new Loan(); Util.go(); }\n}"
    ts = "import { X } from './x';\nimport '../side';\nexport class C extends B { constructor(private s: Svc) { const l = () => import('./lazy'); } }"
    html = '<a href="page.html">x</a><app-card></app-card><img src="i.png">'
    rows = [("d/Desk.java", java), ("d/c.ts", ts), ("d/p.html", html), ("d/x.py", "import os"), ("d/none.java", None)]
    found = graph.extract_edges(spark.createDataFrame(rows, "source string, text string"))
    got = {(r.src, r.dst, r.edge_type, r.weight) for r in found.collect()}
    assert {("d/Desk.java", "a.b.Loan", "IMPORTS", 1.0), ("d/Desk.java", "Base", "INHERITS", 1.0), ("d/Desk.java", "Shut", "INHERITS", 1.0), ("d/Desk.java", "Loan", "INVOKES", 1.0), ("d/Desk.java", "Repo", "CONTAINS", 1.0)} <= got
    assert {("d/c.ts", "d/x", "IMPORTS", 1.0), ("d/c.ts", "side", "IMPORTS", 1.0), ("d/c.ts", "d/lazy", "IMPORTS", 1.0), ("d/c.ts", "B", "INHERITS", 1.0), ("d/c.ts", "Svc", "CONTAINS", 1.0)} <= got
    assert {("d/p.html", "page.html", "REFERENCES", 0.7), ("d/p.html", "app-card", "REFERENCES", 0.7)} <= got
    names = spark.createDataFrame([("a/b/Loan.java",), ("d/x.ts",)], "source string")
    solved = {(r.src, r.dst) for r in graph.resolve(found, names).where("resolved").collect()}
    assert ("d/Desk.java", "a/b/Loan.java") in solved and ("d/c.ts", "d/x.ts") in solved
    fresh = edges(spark, [("d/p.html", "new", 1)])
    kept = graph.replace_edges(found, spark.createDataFrame([("d/p.html",)], "source string"), fresh)
    assert {r.dst for r in kept.where("src = 'd/p.html'").collect()} == {"new"} and kept.where("src = 'd/c.ts'").count() > 0


def test_registry():
    class Other(graph.HtmlPlugin):
        extensions = (".HTML", ".x")

    r = graph.default_registry()
    assert isinstance(r.get(".JAVA"), graph.JavaPlugin) and r.get(".py") is None
    r.register(Other())
    assert isinstance(r.get(".html"), Other)


def test_failing_plugin_gives_no_edges(spark):
    class Bad:
        extensions = (".bad",)

        def extract_edges(self, path, text):
            raise RuntimeError

    out = graph.extract_edges(spark.createDataFrame([("a.bad", "x")], "source string, text string"), graph.Registry([Bad()]))
    assert out.count() == 0


def test_graph_is_built_again_for_changed_files_only(spark, tmp_path):
    from tamarack.operators.index import Index

    class Plugin(graph.HtmlPlugin):
        def extract_edges(self, path, text):
            yield f"{path}:{text}", "REFERENCES", 1.0

    def build(rows):
        return index.build_graph(spark.createDataFrame(rows, "source string, file_hash string, text string"), graph.Registry([Plugin()]))

    index = Index(spark, str(tmp_path))
    assert build([("a.html", "1", "x"), ("b.html", "1", "y")])["add"] == 2
    version = index.collection._state()["version"]
    assert build([("a.html", "1", "not read"), ("b.html", "1", "y")])["unchanged"] == 2 and index.collection._state()["version"] == version
    assert build([("a.html", "1", "not read"), ("b.html", "2", "z"), ("c.html", "1", "w")]) == {"add": 1, "update": 1, "delete": 0, "unchanged": 1}
    assert {r.dst for r in index.collection.read("edges").collect()} == {"a.html:x", "b.html:z", "c.html:w"}
    assert build([("c.html", "1", "w")])["delete"] == 2
    assert {r.dst for r in index.collection.read("edges").collect()} == {"c.html:w"}


def test_hybrid_search_has_no_window_over_the_corpus(spark, tmp_path):
    from tamarack.operators.index import Index

    index = Index(spark, str(tmp_path))
    index.sync_files(spark.createDataFrame([(f"src/m{i}.txt", str(i), f"some text about topic number {i % 5} and more of it") for i in range(40)], "source string, file_hash string, text string"), syntax=False)
    index.build_graph(spark.createDataFrame([("src/m0.txt", "x")], "source string, text string"))
    out = index.hybrid_search("topic number 3", k=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "1073741824" not in plan and "CartesianProduct" not in plan
    assert out.count() == 4
