"""Keeping an index up to date from a stream of file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(stream: DataFrame, index, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge a stream of files (source, file_hash, text, deleted, seq) into an index, batch by batch.

    Of several rows of a source in one batch the last by seq counts. A batch that is run
    again after a failure finds its hashes in place and writes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.withColumn("n_", F.row_number().over(W.partitionBy("source").orderBy(F.desc("seq")))).where("n_ = 1")
        new = last.where("not deleted").select("source", "file_hash", "text")
        untouched = index.collection.read("files").select("source", "file_hash").join(last.select("source"), "source", "left_anti")
        index.sync_files(new.unionByName(untouched.withColumn("text", F.lit(None).cast("string"))))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def active_once(starts: DataFrame, within: str = "1 hour") -> DataFrame:
    """Requests to start (model, ts) without repeats of a model that is under way."""
    return starts.withWatermark("ts", within).dropDuplicatesWithinWatermark(["model"])
