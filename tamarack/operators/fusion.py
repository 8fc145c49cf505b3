"""Hybrid ranking: vectors, wording and the distance in the file graph."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import graph

log = logging.getLogger("tamarack")
SNIPPET = 800


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of its table as bits of an integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & at.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """2 * LCS / (length of both); two empty texts are equal."""
    a, b = a or "", b or ""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio(text: str, snippet: Column) -> Column:
    @F.pandas_udf("double")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: indel_ratio(text, v)).astype(float)

    return of(snippet)


def expand_and_rerank(seeds: DataFrame, text: str, edges: DataFrame, files: DataFrame, alpha: float = 0.3, beta: float = 0.6, max_hops: int = 3, cost: str = "weight") -> DataFrame:
    """file_path, score, cos_norm, lev, path_distance, source, best first.

    seeds, files: file_path, cos_distance, content_snippet; files holds every file that has
    an embedding, or its chunks, of which the nearest counts; others can't be ranked. score = beta^l * (alpha * cos + (1 - alpha) * lev)
    with l the path's distance. Seeds are always returned; without seeds nothing is; with
    beta 0 only they are.
    """
    if not 0 <= alpha <= 1 or not 0 <= beta <= 1:
        raise ValueError("alpha and beta lie between 0 and 1")
    reached = graph.bounded_paths(edges, seeds.select(F.col("file_path").alias("node")), max_hops, cost)
    there = files.join(reached.select(F.col("node").alias("file_path")), "file_path", "left_semi")
    known = there.unionByName(seeds.select(*there.columns)).groupBy("file_path").agg(F.min_by("content_snippet", "cos_distance").alias("content_snippet"), F.min("cos_distance").alias("cos_distance"))
    found = known.join(reached.select(F.col("node").alias("file_path"), F.col("distance").alias("path_distance")), "file_path")
    if beta == 0:
        found = found.where("path_distance = 0")
    return _ranked(found, text, alpha, beta)


def _ranked(found: DataFrame, text: str, alpha: float, beta: float) -> DataFrame:
    ship(found.sparkSession)
    lev = ratio(text, F.substring("content_snippet", 1, SNIPPET)) if alpha < 1 else F.lit(0.0)
    scored = found.withColumn("cos_norm", 1 - F.col("cos_distance")).withColumn("lev", lev)
    decay = F.when(F.col("path_distance") == 0, 1.0).otherwise(F.pow(F.lit(float(beta)), "path_distance"))
    score = decay * (alpha * F.col("cos_norm") + (1 - alpha) * F.col("lev"))
    source = F.when(F.col("path_distance") == 0, "vector").otherwise("graph")
    return scored.select("file_path", score.alias("score"), "cos_norm", "lev", "path_distance", source.alias("source")).orderBy(F.desc("score"), "file_path")


def vector_only(seeds: DataFrame, text: str, alpha: float = 0.3, beta: float = 0.6) -> DataFrame:
    """The same columns from seeds alone."""
    return _ranked(seeds.withColumn("path_distance", F.lit(0.0)), text, alpha, beta)


def expand_or_fall_back(seeds: DataFrame, text: str, load_edges: Callable[[], DataFrame | None], files: DataFrame, alpha: float = 0.3, beta: float = 0.6, max_hops: int = 3) -> DataFrame:
    """expand_and_rerank, or vector_only if edges are None or can't be loaded."""
    try:
        edges = load_edges()
    except Exception as e:  # noqa: BLE001  retrieval never depends on the graph
        log.warning("no graph: %s", e)
        edges = None
    if edges is None:
        return vector_only(seeds, text, alpha, beta)
    return expand_and_rerank(seeds, text, edges, files, alpha, beta, max_hops)
