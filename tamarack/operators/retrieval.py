"""Exact nearest-neighbour search, one chunk a source, relative scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import pairs

#: Numbers in the vectors of a block of chunks, about; of queries a quarter.
BLOCK_VALUES = 4_000_000
#: Queries that are sent to every task, which then needs no Python; more go in blocks.
FEW = 8


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Between two arrays, in doubles: squared Euclidean, 1 - cosine, or minus the inner product."""
    total = lambda x, y, f: F.aggregate(F.zip_with(x, y, lambda p, q: f(p.cast("double"), q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    dot = total(a, b, lambda p, q: p * q)
    if metric == "l2sq":
        return total(a, b, lambda p, q: (p - q) * (p - q))
    if metric == "ip":
        return -dot
    if metric == "cosine":
        return 1 - dot / (F.sqrt(total(a, a, lambda p, q: p * q)) * F.sqrt(total(b, b, lambda p, q: p * q)))
    raise ValueError(f"unknown metric {metric!r}")


def vectors(df: DataFrame, column: str, name: str) -> Column:
    """An array column as floats or doubles."""
    kind = df.schema[column].dataType.simpleString()
    return (F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")).alias(name)


def _distances(chunks: DataFrame, queries: DataFrame, metric: str, n: int, key: str, by: str | None = None) -> DataFrame:
    """Chunks with query_id and distance: a few queries with every chunk; of many, at least each one's n nearest, or nearest of n groups."""
    if metric not in ("l2sq", "cosine", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.select("query_id", vectors(queries, "embedding", "query_embedding"))
    if len(asked.select(F.lit(1)).take(FEW + 1)) <= FEW:
        return chunks.join(F.broadcast(asked)).withColumn("distance", distance(F.col("embedding"), F.col("query_embedding"), metric)).drop("embedding", "query_embedding")
    rows = chunks.withColumn("embedding", vectors(chunks, "embedding", "embedding"))

    def best(a, b):
        b, row, column, value = pairs.best(a, b, n, metric, key, by)
        return b.drop_columns(["embedding", "part_", "block_"]).take(column).append_column("query_id", a["query_id"].take(row)).append_column("distance", value)

    schema = chunks.drop("embedding").schema.add("query_id", queries.schema["query_id"].dataType).add("distance", "double")
    return pairs.cells(rows, asked, key, BLOCK_VALUES).applyInArrow(best, schema)


def _by(key: str, *columns) -> W:
    """Nearest first, null last, ties to the smaller key."""
    return W.partitionBy(*columns).orderBy(F.col("distance").asc_nulls_last(), F.col(key).asc_nulls_last())


def nearest(chunks: DataFrame, queries: DataFrame, n: int, metric: str = "l2sq", key: str = "id") -> DataFrame:
    """The n nearest chunks of each query by distance, then key; rank from 1.

    chunks: key, embedding and more; queries: query_id, embedding. Each task keeps n rows a
    query and block before anything is shuffled.
    """
    return _distances(chunks, queries, metric, n, key).withColumn("rank", F.row_number().over(_by(key, "query_id"))).where(F.col("rank") <= n)


def nearest_one(chunks: DataFrame, vector: list[float], n: int, metric: str = "l2sq", key: str = "id") -> DataFrame:
    """The n nearest chunks of one vector: a sort with a limit, no window."""
    literal = F.array(*(F.lit(float(x)) for x in vector))
    return chunks.withColumn("distance", distance(F.col("embedding"), literal, metric)).drop("embedding").orderBy("distance", key).limit(n)


def one_per_source(hits: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Each source's nearest chunk, k sources a query; a null source counts as the empty string. Ranked anew."""
    of = _by(key, "query_id", F.coalesce("source", F.lit("")))
    best = hits.withColumn("nth_", F.row_number().over(of)).where("nth_ = 1").drop("nth_")
    return best.withColumn("rank", F.row_number().over(_by(key, "query_id"))).where(F.col("rank") <= k)


def nearest_sources(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq", overfetch: int = 3, exact_distinct: bool = False, key: str = "id") -> DataFrame:
    """k sources a query. From the overfetch * k nearest chunks, or from all (exact_distinct)."""
    if not exact_distinct:
        return one_per_source(nearest(chunks, queries, overfetch * k, metric, key), k, key)
    return one_per_source(_distances(chunks, queries, metric, k, key, "source"), k, key)


def relative_scores(hits: DataFrame) -> DataFrame:
    """score: 100 for a query's nearest, 0 for its farthest hit; 100 for all if they tie."""
    of = W.partitionBy("query_id")
    low, high = F.min("distance").over(of), F.max("distance").over(of)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (high - F.col("distance")) / (high - low)))
    return hits.withColumn("score", F.when(high == low, 100.0).otherwise(scaled))


def far_queries(hits: DataFrame, limit: float) -> DataFrame:
    """query_id, best: queries whose nearest hit is farther than a limit."""
    return hits.groupBy("query_id").agg(F.min("distance").alias("best")).where(F.col("best") > limit)


def approximate(chunks: DataFrame, queries: DataFrame, n: int, metric: str = "l2sq", cells: int | None = None, probes: int | None = None, key: str = "id", seed: int = 1) -> DataFrame:
    """nearest() within the cells whose centres are nearest each query (k-means).

    Chunks and queries meet by an equi-join on the cell. By default there are as many cells
    as the square root of the chunks' number, CELLS at most, and a query looks into an
    eighth of them; recall grows with probes. Centres are learned from about SAMPLE chunks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = chunks.count()
    cells = cells or max(1, min(CELLS, math.isqrt(size)))
    probes = probes or -(-cells // 8)
    data = chunks.withColumn("v_", array_to_vector(F.col("embedding").cast("array<double>")))
    few = data if size <= SAMPLE else data.where(F.pmod(F.xxhash64(key), F.lit(size)) < SAMPLE)
    model = KMeans(k=cells, seed=seed, featuresCol="v_", predictionCol="cell", maxIter=10).fit(few)
    spark = chunks.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "id int, embedding array<double>")
    asked = nearest(centres, queries, probes).select("query_id", F.col("id").alias("cell")).join(queries.select("query_id", F.col("embedding").alias("q_")), "query_id")
    met = model.transform(data).drop("v_").join(asked, "cell").withColumn("distance", distance(F.col("embedding"), F.col("q_"), metric)).drop("embedding", "q_", "cell")
    order = W.partitionBy("query_id").orderBy("distance", key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: Cells of an approximate search at most, and chunks from which their centres are learned, about.
CELLS, SAMPLE = 4096, 200_000


def lines(hits: DataFrame) -> DataFrame:
    """query_id, rank, line: one printable entry a hit."""
    shown = F.when(F.length("document") > 600, F.concat(F.substring("document", 1, 600), F.lit("..."))).otherwise(F.col("document"))
    head = F.format_string("[%02d] %5.1f%%  %s  (chunk %d)", "rank", "score", "source", "chunk_index")
    return hits.select("query_id", "rank", F.concat(head, F.lit("\n" + "-" * 60 + "\n"), shown).alias("line"))


def file_lines(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", F.format_string("[%02d] %5.1f%%  %s", "rank", "score", "source").alias("line"))


def json_rows(hits: DataFrame, snippets: bool = False) -> DataFrame:
    """query_id, rank, json: source, score (one decimal), distance and, if asked for, the snippet."""
    more = [F.col("document").alias("snippet")] if snippets else []
    return hits.select("query_id", "rank", F.to_json(F.struct("source", F.round("score", 1).alias("score"), "distance", *more)).alias("json"))
