"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
a DataFrame that is written as Parquet and read again for the next one. All but the last
return the columns of ``documents``, and any others that docs has, whatever their names.

Every stage accepts null ids and texts, repeated rows, very long texts and empty tables; an
empty table stays empty. What ties mean is up to the operators: the smaller doc_id, then the
earlier line, is kept; rows that repeat another row share its fate, but for near_dedup,
which keeps all rows of the doc_id that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import common, decontaminate, langid, linedup, neardup, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language. The model learns from the labels of docs.

    Null texts and texts without a letter go; without any label all texts with a letter stay.
    """
    return langid.recognised(docs, langid.fitted(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, up to a word; emptied ones go.

    Texts that are null or empty stay as they are. Earlier is by doc_id, null last, then by line.
    """
    return linedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8: that of the smallest doc_id.

    Rows without a doc_id or without words are linked with nothing, and stay.
    """
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts, or items, meet nothing."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence; a null text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Trained models, sketches and a tokeniser: not for SQL. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "at"):
            common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
