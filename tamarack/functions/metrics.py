"""Retrieval and answer metrics as column functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hit(item: Column, expected: Column) -> Column:
    return F.exists(expected, lambda e: F.contains(item, e))


def precision_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Of the first k retrieved, how many contain an expected string, divided by k; 0 if none were retrieved."""
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda s: _hit(s, expected))) / F.lit(float(k))


def recall_at(retrieved: Column, expected: Column, k) -> Column:
    """Share of expected strings that one of the first k retrieved contains; 1 if nothing is expected."""
    wanted, top = F.array_distinct(expected), F.slice(retrieved, 1, k)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda e: F.exists(top, lambda s: F.contains(s, e)))) / F.size(wanted))


def recall_at_most(retrieved: Column, expected: Column, k: int = 10) -> Column:
    """recall_at with k, or the number retrieved if that is less."""
    return recall_at(retrieved, expected, F.greatest(F.least(F.size(retrieved), F.lit(k)), F.lit(1)))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    at = F.array_position(F.transform(retrieved, lambda s: _hit(s, expected)), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Distinct lower-cased words: a letter and two or more letters or digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9]{2,}"), F.lit(0)), F.lower))


def stems(sources: Column) -> Column:
    """Distinct file names without their last extension, of four characters or more."""
    names = F.transform(sources, lambda s: F.regexp_replace(F.element_at(F.split(s, "/"), -1), r"\.[^.]*$", ""))
    return F.array_distinct(F.filter(names, lambda x: F.length(x) >= 4))


def faithfulness(answer: Column, sources: Column) -> Column:
    """Share of the sources' stems that occur in the answer, in any case; 1 if there are none."""
    s = stems(sources)
    return F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.filter(s, lambda x: F.contains(F.lower(answer), F.lower(x)))) / F.size(s))


def overlap(answer: Column, reference: Column) -> Column:
    """Share of the reference's tokens that the answer has; 1 if it has none."""
    ref = tokens(reference)
    return F.when(F.size(ref) == 0, 1.0).otherwise(F.size(F.array_intersect(ref, tokens(answer))) / F.size(ref))


def missing(answer: Column, keywords: Column) -> Column:
    """Keywords that the answer lacks, in any case."""
    return F.filter(keywords, lambda k: ~F.contains(F.lower(answer), F.lower(k)))


#: Least mean and least single values that a retrieval run must reach.
GATES = {"p5": 0.35, "r10": 0.50, "mrr": 0.40, "floor": 0.25, "faithfulness": 0.20, "overlap": 0.20}
