import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tamarack.config import Config, deep_merge, load_json, load_prompts, save_json
from tamarack.operators import chunking, diagnostics, sync
from tamarack.operators.index import Index
from tamarack.operators.store import Collection, collections, open_collection
from tamarack.sources import tree

BIG_CLASS = "class Big(Base):\n    limit = 3\n\n" + "".join(f"    def method_{i}(self):\n        return {'x' * 60!r}\n\n" for i in range(8))


@pytest.fixture
def repo(tmp_path):
    files = {
        "pkg/__init__.py": b"VALUE = 1\n", "pkg/deco.py": b"import os\n\n@cached\ndef f():\n    return 1\n\nX = 2\n", "pkg/big.py": BIG_CLASS.encode(), "pkg/bad.py": b"def broken(:\n", "pkg/only.py": b"import os\nimport sys\n",
        "crlf.txt": b"a\r\nb\rc\n", "latin.md": b"caf\xe9 \xc3\xa9 ok", "blank.txt": b" \n\t ", ".env": b"A=1", "prod.env": b"B=2", ".github/x.yml": b"on: push", "_priv/y.TXT": b"seen", "node_modules/x.js": b"no()",
        "big.txt": b"x" * 5001, "just.txt": b"y" * 5000, "image.png": b"\x89PNG",
    }
    for name, content in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path / "repo"


def test_scan(spark, repo):
    rows = {r.source: r for r in tree.with_text(tree.scan(spark, str(repo), max_file_bytes=5000)).collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/deco.py", "pkg/big.py", "pkg/bad.py", "pkg/only.py", "crlf.txt", "latin.md", "blank.txt", "prod.env", ".github/x.yml", "_priv/y.TXT", "just.txt"}
    assert rows["crlf.txt"].text == "a\nb\nc\n" and rows["latin.md"].text == "caf é ok"
    assert rows["prod.env"].file_hash == hashlib.sha256(b"B=2").hexdigest()
    assert {r.source for r in tree.scan(spark, str(repo), [".js"], []).collect()} == {"node_modules/x.js"}
    assert tree.scan(spark, str(repo), []).count() == 0
    assert tree.count_indexable(tree.scan(spark, str(repo), max_file_bytes=5000)).first().n == 12


def test_python_chunks():
    chunk = lambda code, size=800, **k: [c[0] for c in chunking.PythonChunker(size, 50, **k)(code)]
    code = "import os\n\n@cached\ndef f():\n    return 1\n\nX = 2\n"
    assert chunk(code) == ["def f():\n    return 1\n", "X = 2\n"]
    assert chunk(code, keep_imports=True, keep_decorators=True) == ["import os\n", "@cached\ndef f():\n    return 1\n", "X = 2\n"]
    assert chunk("def broken(:\n") == ["def broken(:\n"] and chunk("import os\n") == ["import os\n"] and chunk("") == []
    parts = chunk(BIG_CLASS, 250)
    assert parts[0].startswith("class Big(Base):\n") and "limit = 3" in parts[0]
    assert all(len(p) <= 250 for p in parts) and sum("other methods" in p for p in parts) == 8
    assert all(len(p) <= 60 for p in chunk(BIG_CLASS, 60, keep_imports=True))
    assert chunk('x = "\x0c "\ny = 1\n') == ['x = "\x0c "\n', "y = 1\n"]


def test_dispatch(spark, repo):
    files = tree.with_text(tree.scan(spark, str(repo), max_file_bytes=5000)).select("source", "file_hash", "text")
    raw = chunking.raw_chunks(files, Config(chunk_size=300, overlap=50))
    kinds = {(r.source, r.kind) for r in raw.select("source", "kind").distinct().collect()}
    assert ("pkg/deco.py", "function") in kinds and ("pkg/bad.py", "window") in kinds and ("crlf.txt", "window") in kinds
    assert not any(s == "blank.txt" for s, _ in kinds)
    both = chunking.raw_chunks(files, syntax=False).where("kind <> 'window'").count()
    assert both == 0
    bad = chunking.by_syntax(files, chunkers={"python": lambda s, o: lambda t: 1 / 0})
    assert {r.kind for r in bad.collect()} == {"window"}
    judged = chunking.judged(raw)
    assert chunking.counters(judged).first().failed == judged.where("reason is not null").count()


def manifest(spark, rows):
    return spark.createDataFrame(rows, "source string, file_hash string")


def test_classify(spark):
    now = manifest(spark, [("same", "1"), ("new", "2"), ("changed", "3"), ("unhashed", "4"), ("unreadable", None), ("unreadable new", None)])
    was = manifest(spark, [("same", "1"), ("changed", "0"), ("gone", "9"), ("unhashed", None), ("unreadable", "5")])
    got = {r.source: r.action for r in sync.classify(now, was).collect()}
    assert got == {"same": "unchanged", "new": "add", "changed": "update", "unhashed": "update", "gone": "delete", "unreadable": "unchanged"}
    assert {r.action: r.n for r in sync.summary(sync.classify(now, was)).collect()} == {"add": 1, "update": 2, "delete": 1, "unchanged": 2}
    assert {r.action for r in sync.classify(now.limit(0), was).collect()} == {"delete"}
    assert {r.action for r in sync.classify(now, was.limit(0)).collect()} == {"add"}
    chunks = spark.createDataFrame([("a", "s", "h1"), ("b", "s", None), ("c", "t", "h2")], "id string, source string, file_hash string")
    assert {(r.source, r.file_hash) for r in sync.indexed_hashes(chunks).collect()} == {("s", "h1"), ("t", "h2")}


def test_collections(spark, tmp_path):
    base = str(tmp_path / "base")
    assert collections(spark, base) == []
    with pytest.raises(FileNotFoundError):
        open_collection(spark, base)
    with pytest.raises(ValueError):
        Collection(spark, base, "../x")
    one = Collection(spark, base, "one")
    df = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    assert one.commit({"chunks": df}, {"dim": 2}) == 1 and one.commit({"more": df}) == 2 and one.commit({"more": df}) == 3
    with pytest.raises(ValueError):
        one.commit({"chunks": df.withColumn("embedding", F.array(F.lit(1.0)))})
    assert one.read("chunks").first().embedding == [1.0, 2.0] and one.properties() == {"dim": 2}
    one.vacuum(1)
    assert one.read("chunks").count() == 1 and "v=1" not in os.listdir(f"{base}/one")
    assert open_collection(spark, base).name == "one"
    one.drop()
    assert collections(spark, base) == []


def test_sync_and_search(spark, repo, tmp_path):
    index = Index(spark, str(tmp_path / "index"), Config(max_file_bytes=5000))
    told = []
    assert index.sync(str(repo), on_progress=lambda done, total: told.append((done, total)))["add"] == 12
    assert told[0][0] == 0 and told[-1][0] == told[-1][1] == told[0][1] > 0
    version = index.collection._state()["version"]
    assert index.sync(str(repo)) == {"add": 0, "delete": 0, "update": 0, "unchanged": 12}
    assert index.collection._state()["version"] == version  # nothing changed, nothing was written
    (repo / "crlf.txt").write_bytes(b"entirely new words")
    (repo / "prod.env").unlink()
    (repo / "more.py").write_bytes(b"def more():\n    return 'added later'\n")
    assert index.sync(str(repo)) == {"add": 1, "delete": 1, "update": 1, "unchanged": 10}
    chunks = index.collection.read()
    assert {r.document for r in chunks.where("source = 'crlf.txt'").collect()} == {"// crlf.txt\nentirely new words"}
    assert chunks.where("source = 'prod.env'").count() == 0
    hits = index.search("entirely new words crlf txt", 3).collect()
    assert hits[0].source == "crlf.txt" and hits[0].score == 100 and len(hits) == 3
    made = index.prompts("entirely new words", "Q: <<BUG_TEXT>>\n<<SNIPPETS>>", 2).first()
    assert made.prompt.startswith("Q: entirely new words\n[Snippet 1 from crlf.txt chunk 0]")
    assert diagnostics.totals(chunks).first().sources == chunks.select("source").distinct().count()
    assert index.sync(str(repo), full=True)["add"] == 12
    assert Index.list(spark, str(tmp_path / "index")) == ["chunks"]
    with pytest.raises(ValueError):
        Index.open(spark, str(tmp_path / "index"), config=Config(dimensions=32))
    assert {r.file_path for r in index.hybrid_search("entirely new words", 3).collect()} == {r.source for r in index.search("entirely new words", 3).collect()}


def test_settings(tmp_path):
    assert deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    path = str(tmp_path / "x" / "s.json")
    assert load_json(path) == {}
    save_json(path, {"a": 1})
    assert load_json(path) == {"a": 1}
    with pytest.raises(ValueError):
        load_prompts(path)
    save_json(path, {"summarizer": "s", "chat": "c", "more": 1})
    assert load_prompts(path) == {"summarizer": "s", "chat": "c"}
    assert Config.from_env({"TAMARACK_TOP_K": "5", "TAMARACK_GRAPH": "yes", "TAMARACK_BETA": "0.5"}) == Config(top_k=5, graph=True, beta=0.5)
    with pytest.raises(ValueError):
        Config(chunk_size=10, overlap=10)


def test_diagnostics(spark):
    chunks = spark.createDataFrame([("1", "a.PY"), ("2", "a.PY"), ("3", "b.md"), ("4", "none")], "id string, source string")
    assert [(r.ext, r.chunks, r.sources) for r in diagnostics.by_extension(chunks).collect()] == [("py", 2, 1), ("md", 1, 1)]
    assert diagnostics.first_of(chunks, ".py").first().id == "1"
    assert [r.source for r in diagnostics.first_sources(chunks, 2).collect()] == ["a.PY", "b.md"]
    tags = spark.createDataFrame([("m:1", "x"), ("", "m2"), (None, "m2"), (None, None)], "name string, model string")
    names = diagnostics.models(tags)
    assert [r.name for r in names.collect()] == ["m2", "m:1"]
    known = spark.createDataFrame([("m", "base", 1), ("m2x", "other", 2)], "base string, description string, priority int")
    assert {(r.name, r.description) for r in diagnostics.described(names, known, "-").collect()} == {("m2", "base"), ("m:1", "base")}
    hits = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 3.0)], "source string, score double")
    assert [(r.source, r.best, r.chunks) for r in diagnostics.result_files(hits).collect()] == [("a", 5.0, 2), ("b", 3.0, 1)]
