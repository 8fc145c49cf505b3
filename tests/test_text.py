import os.path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators.chunking import cut


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_windows_equal_the_loop(spark):
    texts = ["", "a", "x" * 9, "x" * 10, "x" * 11, "x" * 17, "x" * 18, "😀é" * 30, "".join(map(str, range(200)))]
    for size, overlap in ((10, 3), (10, 0), (7, 6)):
        assert column(spark, texts, lambda c: T.windows(c, size, overlap)) == [cut(t, size, overlap) for t in texts]  # noqa: B023


@pytest.mark.parametrize("size, overlap", [(10, 10), (10, 11), (0, 0), (5, -1)])
def test_windows_must_advance(size, overlap):
    with pytest.raises(ValueError):
        cut("abc", size, overlap)
    with pytest.raises(ValueError):
        T.windows(None, size, overlap)


def test_extension_is_that_of_splitext(spark):
    paths = ["a.py", ".env", "prod.env", "..a.b", "a.", "x/.github/w.YML", "noext", "a.tar.gz", "d.ir/file", "...", ".a.B"]
    assert column(spark, paths, T.extension) == [os.path.splitext(p)[1].lower() for p in paths]


def test_predicates(spark):
    paths = ["a.py", "a.csx", "b.h", "x.bin", "node_modules/a.js", "build", "a/build/b.c", "Build/b.c"]
    assert column(spark, paths, T.is_code) == [True, True, False, False, True, False, True, True]
    assert column(spark, paths, T.language) == ["python", "unknown", "c", "unknown", "javascript", "unknown", "c", "c"]
    assert column(spark, paths, T.in_excluded) == [False] * 4 + [True, False, True, False]
    assert column(spark, paths, lambda c: T.in_excluded(c, [])) == [False] * 8
    assert column(spark, paths, lambda c: T.indexable(c, [])) == [False] * 8
    assert column(spark, [" \n", "\xa0", "a", ""], T.not_blank) == [False, False, True, False]


def plain(text):
    import re

    text = "".join(c for c in text if ord(c) >= 32 or c in "\n\t\r")
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab\n\t\r\x00\x07\x0b\x7f \xa0\x85é", max_size=20), min_size=20, max_size=40))
def test_sanitize(spark, texts):
    texts += ["a\n\n\nb", "a\n\n\n\nb", "a\n\n\n\n\nb", "\xa0x\xa0"]
    assert column(spark, texts, T.sanitize) == [plain(t) for t in texts]


def test_reasons(spark):
    good = "a" * 70 + "​" * 30
    texts = ["", " \n", "a" * 8000, "a" * 8001, good, good + "​", "\x00" * 11 + "a", "\x00" * 10 + "a"]
    assert column(spark, texts, T.invalid_reason) == ["empty", "empty", None, "too_long", None, "unprintable", "null_bytes", None]


def test_small_helpers(spark):
    assert column(spark, [0, 1023, 1536, 1 << 20, 5 << 40, 3 << 50], T.byte_size, "long") == ["0.0 B", "1023.0 B", "1.5 KB", "1.0 MB", "5.0 TB", "3.0 PB"]
    assert column(spark, ["a, b,,c ,", ""], T.listed) == [["a", "b", "c"], []]
    assert column(spark, ["7", " 8 ", "x", None], lambda c: T.safe_int(c, 3)) == [7, 8, 3, 3]
    assert all(len(x) >= 5100 for x in column(spark, ["short", "y" * 6000], T.padded))
    assert column(spark, ["p"], lambda c: T.chunk_id(c, F.lit(3))) == ["p::chunk_3"]
    assert column(spark, ["p"], lambda c: T.with_header(c, F.lit("body"))) == ["// p\nbody"]
    assert column(spark, [{"a": True, "b": False}], T.enabled, "map<string,boolean>") == [1]


def test_sizes_beyond_the_last_unit(spark):
    short = lambda c: T.byte_size(c, ("B", "KB", "MB", "GB", "TB"))
    assert column(spark, [1536, 3 << 50], short, "long") == ["1.5 KB", "3072.0 TB"]
    assert column(spark, [3 << 50], T.byte_size, "long") == ["3.0 PB"]


def test_sizes_of_long_texts_as_in_sql(spark, tmp_path):
    import duckdb

    from tamarack.plans import registry

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, '' AS text, 'en' AS lang, 's' AS source, i * 20011 AS n_chars FROM range(12) t(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rows = registry.QUERIES["q35_scalar_helpers"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(registry.ORACLE_SQL["q35_scalar_helpers"]).fetchall())
