"""What an index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_extension(chunks: DataFrame) -> DataFrame:
    """ext, chunks, sources: most chunks first; sources without a point have no extension and are left out."""
    ext = F.lower(F.regexp_extract("source", r"\.([^.]*)$", 1))
    found = chunks.where(F.contains("source", F.lit("."))).groupBy(ext.alias("ext"))
    return found.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources")).orderBy(F.desc("chunks"), "ext")


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))


def result_files(hits: DataFrame) -> DataFrame:
    """source, best, chunks: of each file among the hits, best first."""
    return hits.groupBy("source").agg(F.max("score").alias("best"), F.count("*").alias("chunks")).orderBy(F.desc("best"), "source")


def dimensions(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    """dim, n: how many vectors have how many components."""
    return chunks.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n"))


def first_sources(chunks: DataFrame, n: int = 20) -> DataFrame:
    return chunks.select("source").distinct().orderBy("source").limit(n)


def first_of(chunks: DataFrame, extension: str) -> DataFrame:
    """The first chunk by id of an extension."""
    return chunks.where(F.lower("source").endswith(extension.lower())).orderBy("id").limit(1)


def models(tags: DataFrame) -> DataFrame:
    """name: distinct model names of a service's list (name, model), in order."""
    return tags.select(F.coalesce(F.nullif("name", F.lit("")), "model").alias("name")).where("name is not null").distinct().orderBy("name")


#: Seconds that indexing takes a file: by windows, and along syntax.
SECONDS = {"fast": 0.06, "syntax": 0.37}


def estimate(files: DataFrame, workers: int = 1) -> DataFrame:
    """files, fast_seconds, syntax_seconds: one row, before anything is indexed."""
    if workers < 1:
        raise ValueError("workers must be at least 1")
    return files.agg(F.count("*").alias("files"), *((F.count("*") * s / workers).alias(f"{n}_seconds") for n, s in SECONDS.items()))


#: Rows of a list of known models.
KNOWN = 10_000


def described(names: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """names (name) with a description: that of the base name, else of the first known prefix (by priority), else the default.

    known (base, description, priority) is a short list of KNOWN rows at most; prefixes meet
    names by a nested loop.
    """
    if known.limit(KNOWN + 1).count() > KNOWN:
        raise ValueError(f"more than {KNOWN} known models")
    base = F.substring_index("name", ":", 1)
    exact = known.select(F.col("base").alias("b_"), F.col("description").alias("exact"))
    prefix = names.join(F.broadcast(known), base.startswith(known.base)).groupBy("name").agg(F.min_by("description", "priority").alias("prefix"))
    return names.join(F.broadcast(exact), base == F.col("b_"), "left").join(prefix, "name", "left").select("name", F.coalesce("exact", "prefix", F.lit(default)).alias("description"))
