"""A file tree as a DataFrame.

Spark's own file sources hide names that begin with ``_`` or ``.``; this one is a Python
data source that sees them. Folders and files are chosen on the driver, by name and size;
executors read the bytes.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import EXCLUDED, INDEXED, Config
from ..functions import text as T
from ..session import ship

BATCH_BYTES = 16 << 20


class _Files(InputPartition):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.limit = int(options.get("maxFileBytes", Config.max_file_bytes))
        listed = lambda key, default: default if options.get(key) is None else frozenset(x.strip() for x in options[key].split(",") if x.strip())
        self.extensions, self.excluded = listed("extensions", INDEXED), listed("excludeDirs", EXCLUDED)

    def names(self):
        """(relative path, size) of the files that count."""
        for folder, folders, files in os.walk(self.root):
            folders[:] = sorted(d for d in folders if d not in self.excluded)
            for name in sorted(files):
                full = os.path.join(folder, name)
                if os.path.splitext(name)[1].lower() in self.extensions:
                    try:
                        size = os.path.getsize(full)
                    except OSError:
                        continue
                    if size <= self.limit:
                        yield os.path.relpath(full, self.root).replace(os.sep, "/"), size

    def partitions(self):
        out, names, total = [], [], 0
        for name, size in self.names():
            names.append(name)
            total += size
            if total >= BATCH_BYTES:
                out.append(_Files(self.root, names))
                names, total = [], 0
        return out + ([_Files(self.root, names)] if names or not out else [])

    def read(self, partition):
        for name in partition.names:
            full = os.path.join(partition.root, name)
            try:
                with open(full, "rb") as f:
                    content = f.read()
            except OSError:
                content = None  # known to be there, but not readable: an index keeps what it has
            yield name, full, None if content is None else len(content), content


class TreeDataSource(DataSource):
    """format("tree"): options path, extensions, excludeDirs (comma-separated), maxFileBytes."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "source string, full_path string, length long, content binary"

    def reader(self, schema):
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, extensions=None, excluded=None, max_file_bytes: int = Config.max_file_bytes) -> DataFrame:
    """source, full_path, length, content. None: the defaults; an empty collection is empty."""
    ship(spark)
    spark.dataSource.register(TreeDataSource)
    reader = spark.read.format("tree").option("path", root).option("maxFileBytes", max_file_bytes)
    for key, value in (("extensions", extensions), ("excludeDirs", excluded)):
        if value is not None:
            reader = reader.option(key, ",".join(sorted(value)))
    return reader.load()


def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 without what can't be decoded; all line ends become line feeds."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))


def with_text(files: DataFrame) -> DataFrame:
    """files with file_hash (SHA-256 of the bytes) and text."""
    ship(files.sparkSession)
    return files.withColumn("file_hash", F.sha2("content", 256)).withColumn("text", F.pandas_udf(decoded, "string")("content"))


def count_indexable(files: DataFrame) -> DataFrame:
    """n: files of files (source, length) that an index would take."""
    good = T.indexable(F.col("source")) & ~T.in_excluded(F.col("source")) & (F.col("length") <= Config.max_file_bytes)
    return files.where(good).agg(F.count("*").alias("n"))


def json_lines(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Rows of a JSON-lines text; blank and broken lines are left out."""
    reader = spark.readStream if streaming else spark.read
    parsed = reader.text(path).select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"), "value")
    return parsed.where("trim(value) <> '' and r is not null and r._broken is null").select("r.*").drop("_broken")
