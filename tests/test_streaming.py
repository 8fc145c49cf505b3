import hashlib

from tamarack.operators.index import Index
from tamarack.sources import tree
from tamarack.streaming import progress, watch

RECORDS = [
    ("a", 1, "pulling", 100, 10, None), ("a", 2, "pulling", None, None, None), ("a", 3, "pulling", 0, 5, None), ("a", 4, "verifying", 100, 250, None),
    ("b", 1, "pulling", 100, 50, None), ("b", 2, None, None, None, "no space"), ("b", 3, "success", 100, 100, None),
    ("c", 1, "pulling", 200, 20, None), ("c", 2, "success", None, None, None), ("c", 3, "pulling", 200, 1, None), ("d", 1, "pulling", None, None, None),
]
FIELDS = "model string, seq long, status string, total long, completed long, error string"
EXPECTED = {"a": (100.0, True, True, None), "b": (50.0, True, False, "no space"), "c": (100.0, True, True, None), "d": (0.0, False, False, None)}


def test_fold(spark):
    got = progress.fold(spark.createDataFrame(RECORDS, FIELDS)).collect()
    assert {r.model: (r.percent, r.done, r.ok, r.error) for r in got} == EXPECTED
    assert {r.model: r.status for r in got} == {"a": "verifying", "b": "pulling", "c": "success", "d": "pulling"}


def test_fold_stream(spark, tmp_path):
    for i, part in enumerate((RECORDS[:5], RECORDS[5:])):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = progress.fold_stream(source).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("folded").collect():
        last[r.model] = (r.percent, r.done, r.ok, r.error)
    assert last == EXPECTED


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert [r.a for r in tree.json_lines(spark, str(tmp_path / "x.ndjson"), "a int").collect()] == [1, 2]


def test_follow(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    fields = "source string, file_hash string, text string, deleted boolean, seq long"
    batches = [[("a.txt", "one", False, 1), ("b.txt", "two", False, 2)], [("a.txt", "three", False, 3), ("b.txt", "two", True, 4), ("c.txt", "four", False, 5), ("c.txt", "five", False, 6)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, digest(t), t, d, n) for s, t, d, n in rows], fields).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(fields).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        watch.follow(stream, index, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.document for r in index.collection.read().collect()} == {"// a.txt\nthree", "// c.txt\nfive"}
