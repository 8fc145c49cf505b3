import random

import corpus_pipeline
from tamarack.llm import common, decontaminate, langid, neardup

from . import brute

EN = "the of and that with from this have which their would there about could than first into only some these then such years people after work".split()
DE = "der die und das nicht eine mit auf werden haben schaft zwischen ist ein zu von den dem sich auch".split()


def rows():
    rng = random.Random(8)
    out = []
    for i in range(80):
        words = EN if i % 2 else DE
        text = "\n".join(" ".join(f"{rng.choice(words)}{rng.choice(['', '', 'er', 'ing', 'en'])}" for _ in range(rng.randint(12, 30))) for _ in range(rng.randint(1, 5)))
        out.append((i, text, "en" if i % 2 else "de"))
    out += [(100, out[3][1], "en"), (101, None, "en"), (102, "12 34", None), (103, "", "de")]
    near = out[5][1].replace("\n", " ").split()
    out += [(104, " ".join(near), "en"), (105, " ".join([*near[:-1], "changed"]), "en")]
    return out


ITEM = "which of these two people would have work after the first years in town"


def test_stages_against_brute_force(spark, tmp_path):
    data = [*rows(), (200, "das ist nicht der erste " + ITEM + " und so weiter", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            gone = brute.dropped_lines(before.items())
            for i, t in before.items():
                lines = [x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(i, [])]
                assert (i in after) == (i not in gone or bool("".join(lines).strip()))
                assert i not in after or (after[i] or "") == "\n".join(lines)
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.components(before.items(), 5).items() if i == c}
    assert {101, 102, 103} & set(kept["language_id"]) == set()
    assert {i for i, t, _ in data if t and i not in (102,)} - {103} == set(kept["language_id"])
    assert 100 not in kept["line_dedup"] and 105 not in kept["near_dedup"]
    assert 200 in kept["near_dedup"] and 200 not in kept["decontamination"]
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])


def test_clashing_columns_repeated_rows_and_nulls(spark, tmp_path):
    """Each stage keeps columns with names that operators use themselves, and treats repeated rows alike."""
    clash = ["d_", "r_", "dropped_", "new_", "id", "rid", "label", "band", "score", "rejected", "letters_", "kept", "y", "cut", "component_id", "n_chars_"]
    data = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows()] * 2 + [(None, "der die das und nicht eine mit auf werden haben", "de", "s", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'x' as {c}" for c in clash))
    spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None)], "item_id long, text string").selectExpr("*", "'x' as rid", "'y' as hash").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        times = {}
        for r in docs.collect():
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert times and all(n == 2 for i, n in times.items() if i is not None)
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= docs.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert callable(langid.recognised) and callable(neardup.one_of_each) and callable(decontaminate.without_leaks)
