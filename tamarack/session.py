"""Shipping this package to Python workers, and the session used by the command line and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in this application's Python workers, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tamarack-"), f"tamarack-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tamarack", os.path.relpath(full, home)))
    sc.addPyFile(path)


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with the package at hand in the workers.

    Workers are used again by later stages, so each task ends by giving back its memory.
    """
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A scan has a partition for each split that its files allow, which on large tables is
    plenty; then nothing changes. A table of one row group would be worked on by one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tamarack")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
