"""Approximate nearest neighbours by cross-polytope hashing.

Vectors get one more component that makes all of them equally long, so the largest inner
product is the smallest angle; then each table turns them by a pseudo-rotation (three
rounds of random signs and a fast Hadamard transform) and names the nearest signed axis.
A table's cell is made of as many axes as the number of vectors asks for. Queries look
into several cells a table, in the order of how near their axes are; what is found there
is ranked by the exact inner product.

A cell's vectors and queries meet in blocks of bounded size, so a crowded cell is spread
over many tasks. Equal vectors are folded into one before they are hashed, and each is
hashed once. A query that finds too few neighbours is compared with all vectors, also in
blocks.

How large cells are and how many a query looks into follows from the table: ``SAMPLE``
queries are compared with all vectors; their true neighbours (a bounded number) show which
share of them any choice finds. Of the choices that find ``RECALL``, the one that compares
the fewest vectors is taken; the last choice is one cell that holds all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import map_in_arrow, ship
from . import common

TABLES = 12
#: Vectors in a cell, at least about.
PER_CELL = 64
BLOCK, QUERY_BLOCK = 1024, 512
#: Queries compared with all vectors; the recall asked of them is 0.9 and two standard errors.
SAMPLE, RECALL = 200, 0.92
#: Cells of a table that a query looks into, at most.
MOST_PROBES = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def axes(bits: int, dimensions: int) -> list[int]:
    """Signed axes that each of a cell's functions tells apart: together 2^bits."""
    full = int(math.log2(dimensions)) + 1
    out = [2**full] * (bits // full)
    return out + [2 ** (bits % full)] * (bits % full > 0)


def rotations(x: np.ndarray, table: int, functions: int) -> list[np.ndarray]:
    """The rows of x turned by each function of a table."""
    out = []
    for f in range(functions):
        signs = np.random.default_rng([31, table, f]).choice([-1.0, 1.0], (3, x.shape[1]))
        y = x
        for s in signs:
            y = hadamard(y * s)
        out.append(y)
    return out


def cells(x: np.ndarray, table: int, bits: int, probes: int) -> np.ndarray:
    """For each row the numbers of the nearest cells of a table, nearest first."""
    sizes = axes(bits, x.shape[1])
    best, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for size, y in zip(sizes, rotations(x, table, len(sizes)), strict=True):
        half = max(1, size // 2)
        signed = np.concatenate([y[:, :half], -y[:, :half]], 1)[:, :size]
        take = min(probes, size)
        near = np.argpartition(-signed, take - 1, 1)[:, :take] if take < size else np.broadcast_to(np.arange(size), signed.shape)
        far = (signed.max(1, keepdims=True) - np.take_along_axis(signed, near, 1)) ** 2
        both = (cost[:, :, None] + far[:, None, :]).reshape(len(x), -1)
        code = (best[:, :, None] * size + near[:, None, :]).reshape(len(x), -1)
        if both.shape[1] > probes:  # the nearest, ties to the first
            keep = np.sort(np.argpartition(both, probes - 1, 1)[:, :probes], 1)
            code, both = np.take_along_axis(code, keep, 1), np.take_along_axis(both, keep, 1)
        keep = np.argsort(both, 1, kind="stable")
        best, cost = np.take_along_axis(code, keep, 1), np.take_along_axis(both, keep, 1)
    return best


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows of equal length 1 whose angles rank as inner products; padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, 1 << max(1, d).bit_length()))
    norm = np.linalg.norm(x, axis=1)
    if query:
        out[:, :d] = x / norm[:, None]
    else:
        out[:, :d] = x / longest
        out[:, d] = np.sqrt(np.maximum(0.0, 1 - (norm / longest) ** 2))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector that isn't null or zero and has only finite components, of the commonest dimension."""
    v = F.col(column)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(v.isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size(v) == (sizes[0].d if sizes else -1))


def _hashed(classes: DataFrame, longest: float, bits: int, tables: int, probes: int, query: bool) -> DataFrame:
    """id, vector, cells: each vector with its cells in all tables, written once."""
    vector = classes.schema["vector"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            step = min(1000, max(8, 500_000 // probes**2))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = lifted(_matrix(part.column(1)), longest, query)
                every = np.concatenate([cells(x, t, bits, probes) * tables + t for t in range(tables)], 1)
                lists = pa.ListArray.from_arrays(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32), pa.array(every.ravel()))
                yield pa.record_batch([part.column(0), part.column(1), lists], ["id", "vector", "cells"])

    return common.written(map_in_arrow(classes.select("id", "vector"), make, f"id {classes.schema['id'].dataType.simpleString()}, vector {vector}, cells array<long>"), "cells")


def _blocks(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """q, id, score: for each query and block, the k best of the block. queries, data: id, vector, cells."""
    ship(queries.sparkSession)
    sizes = lambda df, name: df.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias(name))
    crowded = sizes(data, "n").join(sizes(queries, "m"), "cell").where((F.col("n") > BLOCK) | (F.col("m") > QUERY_BLOCK))
    crowded = common.written(crowded.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("parts")), "crowded")
    one = lambda c: F.coalesce(c, F.lit(1))
    up_to = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))

    def dealt(df, own, own_n, other, other_n):
        each = df.select(F.explode("cells").alias("cell"), "id", "vector").join(common.beside(crowded), "cell", "left")
        return each.select("cell", F.pmod(F.xxhash64("id"), one(own_n)).cast("int").alias(own), up_to(other_n).alias(other), "id", "vector")

    left, right = dealt(queries, "part", "parts", "block", "blocks"), dealt(data, "block", "blocks", "part", "parts")

    def best(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"q": a["id"].slice(0, 0), "id": b["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        ids = b["id"].combine_chunks()
        x, y = _matrix(a["vector"].combine_chunks()), _matrix(b["vector"].combine_chunks())
        scores = x @ y.T
        take = min(k, scores.shape[1])
        # Whatever ties with the last place stays, so ties can be settled by id later.
        last = -np.partition(-scores, take - 1, 1)[:, take - 1]
        row, column = np.nonzero(scores >= last[:, None] - 1e-12 * np.abs(last[:, None]))
        return pa.table({"q": a["id"].combine_chunks().take(pa.array(row)), "id": ids.take(pa.array(column)), "score": pa.array(_products(x, y, row, column))})

    kind = data.schema["id"].dataType.simpleString()
    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"q {kind}, id {kind}, score double")


def _products(x: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed in the same order whatever block it is in."""
    out = np.empty(len(row))
    for i in range(0, len(row), step := max(1, (1 << 22) // max(1, x.shape[1]))):
        out[i : i + step] = np.multiply(x[row[i : i + step]], y[column[i : i + step]]).sum(1)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    return one.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k).drop("n")


def neighbours(asked: DataFrame, folded: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sample of queries (vectors), the vectors of their k nearest, and whose each of these is.

    The sample, of SAMPLE rows, goes to the vectors, which aren't shuffled; k of them a query come back.
    """
    ship(asked.sparkSession)
    some = asked.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    ids, matrix = some["id"].combine_chunks(), _matrix(some["vector"].combine_chunks())
    number = {x: i for i, x in enumerate(ids.to_pylist())}

    def near(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            scores = matrix @ x.T
            take = min(k + 1, len(x))
            best = np.argpartition(-scores, take - 1, 1)[:, :take]
            row, column = np.repeat(np.arange(len(best)), take), pa.array(best.ravel())
            yield pa.record_batch([ids.take(pa.array(row)), batch.column(0).take(column), pa.array(scores[row, best.ravel()]), batch.column(1).take(column)], ["q", "id", "score", "vector"])

    kind, vector = folded.schema["id"].dataType.simpleString(), folded.schema["vector"].dataType.simpleString()
    found = map_in_arrow(folded.select("id", "vector"), near, f"q {kind}, id {kind}, score double, vector {vector}").where("id <> q")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)
    got = found.select("q", "vector").toArrow()
    return matrix, _matrix(got["vector"].combine_chunks()), np.array([number[x] for x in got["q"].to_pylist()], int)


def tuned(queries: np.ndarray, found: np.ndarray, of: np.ndarray, longest: float, n: int, tables: int = TABLES, per_cell: int = PER_CELL) -> tuple[int, int]:
    """(bits, probes): of cells and of looks into them, with which RECALL of the neighbours found is met, and the fewest vectors are compared.

    bits 0: one cell that holds all.
    """
    best, cost = (0, 1), float(n)
    if not len(found):
        return best
    top = max(0, math.ceil(math.log2(n / per_cell)))
    up, low = lifted(queries, longest, True), lifted(found, longest, False)
    for bits in range(top, max(1, top - 8) - 1, -1):
        most = min(MOST_PROBES, 1 << bits, int(cost * 2.0**bits / n / tables))  # with more, it costs more than what is there
        if most < 1:
            continue
        place = np.full(len(low), most)
        for t in range(tables):
            looks = np.concatenate([cells(up[i : i + 16], t, bits, most) for i in range(0, len(up), 16)])
            same = looks[of] == cells(low, t, bits, 1)
            place = np.minimum(place, np.where(same.any(1), same.argmax(1), most))
        probes = int(np.sort(place)[math.ceil(RECALL * len(place)) - 1]) + 1
        if probes <= most and tables * probes * n / 2.0**bits < cost:
            best, cost = (bits, probes), tables * probes * n / 2.0**bits
    return best


def search(vectors: DataFrame, query=None, k: int = 20, tables: int = TABLES, per_cell: int = PER_CELL, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself not counted.

    query: a condition on vectors that picks the queries; by default ids divisible by 20.
    Vectors that are null, zero, hold a null or non-finite component, or have another
    dimension than most take no part; nor do rows without an id. tuned() chooses cells and
    probes; per_cell is the least number of vectors a cell has, about. Rows that share an id
    and a vector count once. Ties go to the smaller id. Other columns are left alone; an
    empty table gives no rows.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    asks = query if query is not None else F.pmod(F.col(id_column), F.lit(20)) == 0
    own = vectors.schema[column].dataType.simpleString()
    vector = F.col(column) if own in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    rows = usable(vectors.where(F.col(id_column).isNotNull()), column).select(F.col(id_column).alias("vec_id"), vector.alias("vector"), asks.alias("asks")).distinct()
    rows = common.written(rows, "vectors")
    folded = rows.groupBy("vector").agg(F.min("vec_id").alias("id"), F.max("asks").alias("asks"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    folded = common.written(folded.select("vector", "id", "asks", length.alias("length")), "folded", n=F.count(F.lit(1)), longest=F.max("length"))
    n, longest = folded.counts["n"], folded.counts["longest"]
    if not n:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    order = W.partitionBy("vector").orderBy("vec_id")
    some = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = common.written(some.join(folded.select("vector", "id"), "vector").select("id", "vec_id"), "members")
    asked = folded.where("asks")
    bits, probes = tuned(*neighbours(asked, folded, k), longest, n, tables, per_cell) if n > 2 * per_cell else (0, 1)
    if not bits:
        tables = 1
    hashed = lambda df, bits, tables, probes, query: _hashed(df, longest, bits, tables, probes, query)
    data = hashed(folded, bits, tables, 1, False)
    found = common.written(_top(_blocks(hashed(asked, bits, tables, probes, True), data, k + 1), k + 1), "found")
    short = asked.join(found.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select(F.col("q").alias("id")), "id", "left_anti")
    short = common.written(short, "short", n=F.count(F.lit(1)))
    if bits and short.counts["n"]:
        all_ = common.written(_top(_blocks(hashed(short, 0, 1, 1, True), hashed(folded, 0, 1, 1, False), k + 1), k + 1), "found")
        found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(all_)
    queries = rows.where("asks").join(folded.select("vector", F.col("id").alias("q")), "vector").select("q", F.col("vec_id").alias("query_id"))
    pairs = queries.join(found, "q").join(members, "id").where("vec_id <> query_id").select("query_id", "vec_id", "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the 20 nearest of every vector whose id is divisible by 20."""
    return search(common.table(spark, sf_dir, "embeddings"))
