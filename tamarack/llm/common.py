"""Reading tables, cutting lineage and fixed seeds, shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, spread over all cores; the path may be in any store that Spark reads."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where none is set, a session on this machine alone gets a temporary one; on a cluster,
    whose executors wouldn't see it, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, what: str, **counts: Column) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    This cuts the lineage: losing an executor costs a read, not the computation. ``at``
    on the result is the table's path; counts are aggregates over the rows, taken while
    they are written, and found in its ``counts``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tamarack/{what}-{uuid.uuid4().hex}"
    watch = Observation() if counts else None
    rows = df.observe(watch, *(c.alias(n) for n, c in counts.items())) if counts else df
    rows.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.at = path
    out.counts = watch.get if counts else {}
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path, fs = _path(df)
        fs.delete(path, True)


def _path(df: DataFrame):
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fold(column: str = "doc_id"):
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string"))


#: Bytes on disk, compressed, of what is broadcast; in memory it may be some ten times that.
BESIDE = 1 << 19


def beside(df: DataFrame, size: int = BESIDE) -> DataFrame:
    """df (a written table) marked for broadcast, if its files hold at most so many bytes.

    Beyond that it is left to a shuffled join, which gives the same rows.
    """
    path, fs = _path(df)
    return F.broadcast(df) if fs.getContentSummary(path).getLength() <= size else df
