"""Incremental maintenance: classify sources by hash, replace only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("add", "delete", "unchanged", "update")


def indexed_hashes(chunks: DataFrame) -> DataFrame:
    """source, file_hash of what is indexed; that of the last chunk id where several differ."""
    return chunks.groupBy("source").agg(F.max_by("file_hash", F.when(F.col("file_hash").isNotNull(), F.col("id"))).alias("file_hash"))


def classify(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """source, file_hash, action: one full outer join on source.

    A source indexed without a hash is an update. A null hash in current means it can't be
    read: what is indexed of it stays.
    """
    new = current.select("source", F.col("file_hash").alias("now"), F.lit(True).alias("here"))
    old = indexed.select("source", F.col("file_hash").alias("was"), F.lit(True).alias("there"))
    action = (
        F.when(F.col("there").isNull(), F.when(F.col("now").isNotNull(), "add"))
        .when(F.col("here").isNull(), "delete")
        .when(F.col("now").isNull() | (F.col("now") == F.col("was")), "unchanged")
        .otherwise("update")
    )
    return new.join(old, "source", "full_outer").select("source", F.coalesce("now", "was").alias("file_hash"), action.alias("action")).where("action is not null")


def summary(classified: DataFrame) -> DataFrame:
    """action, n for every action, those that don't occur included."""
    every = classified.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    return every.join(classified.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge(chunks: DataFrame, classified: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of unchanged sources and the fresh chunks of added and updated ones."""
    gone = classified.where(F.col("action").isin("update", "delete")).select("source")
    return chunks.join(gone, "source", "left_anti").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))
