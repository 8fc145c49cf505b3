"""Versioned Parquet collections with an atomic pointer to the current version.

``base/<collection>/v=<n>/`` holds the tables of a version, ``base/<collection>/current``
its number and properties. A version is written whole before the pointer moves, so readers
see the old one or the new one, never a mixture.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NAME

CHUNKS = "id string, source string, chunk_index int, document string, file_hash string, embedding array<double>"
FILES = "source string, file_hash string, n_chunks long"


class Collection:
    """One collection below a base path, in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, base: str, name: str):
        if not NAME.match(name):
            raise ValueError(f"not a collection name: {name!r}")
        self.spark, self.name, self.home = spark, name, f"{base.rstrip('/')}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _state(self) -> dict:
        p, fs, jvm = self._fs(f"{self.home}/current")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._state())

    def properties(self) -> dict:
        return self._state().get("properties", {})

    def read(self, table: str = "chunks") -> DataFrame:
        """A table of the current version; an empty one if the collection doesn't exist."""
        state, schema = self._state(), {"chunks": CHUNKS, "files": FILES}.get(table)
        if not state or table not in state["tables"]:
            if schema is None:
                raise FileNotFoundError(f"{self.name} has no table {table}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.home}/v={state['version']}/{table}")

    def commit(self, tables: dict, properties: dict | None = None) -> int:
        """Write a new version and point to it. Tables that aren't given are carried over.

        A table is a DataFrame, or a function that makes one from read(name), which reads
        the tables before it as this version has them.
        """
        state = self._state()
        version = state.get("version", 0) + 1
        for old in state.get("tables", []):
            if old not in tables:
                tables = {**tables, old: self.read(old)}
        read = lambda name: self.spark.read.parquet(f"{self.home}/v={version}/{name}")
        for name, df in tables.items():
            df = df if isinstance(df, DataFrame) else df(read)
            df.write.mode("overwrite").parquet(f"{self.home}/v={version}/{name}")
        new = {"version": version, "tables": sorted(tables), "properties": {**state.get("properties", {}), **(properties or {})}}
        self._check(new)
        p, fs, jvm = self._fs(f"{self.home}/current")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.home}/current-{uuid.uuid4().hex}")
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(new, indent=2).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, p, options)
        return version

    def _check(self, state: dict) -> None:
        dim = state["properties"].get("dim")
        if dim is not None and "chunks" in state["tables"]:
            wrong = self.spark.read.parquet(f"{self.home}/v={state['version']}/chunks").where(F.size("embedding") != int(dim)).limit(1)
            if not wrong.isEmpty():
                raise ValueError(f"an embedding hasn't {dim} components")

    def drop(self) -> None:
        p, fs, _ = self._fs(self.home)
        fs.delete(p, True)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions."""
        state = self._state()
        for v in range(1, state.get("version", 0) - keep + 1):
            p, fs, _ = self._fs(f"{self.home}/v={v}")
            fs.delete(p, True)


def collections(spark: SparkSession, base: str) -> list[str]:
    """Names of the collections below a path, in order."""
    p, fs, _ = Collection(spark, base, "x")._fs(base)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in found if NAME.match(n) and Collection(spark, base, n).exists())


def open_collection(spark: SparkSession, base: str, name: str | None = None) -> Collection:
    """The named collection, or the first by name; an error if there is none."""
    names = collections(spark, base)
    if name is None and names:
        name = names[0]
    if name not in names:
        raise FileNotFoundError(f"no collection {name or ''} below {base}")
    return Collection(spark, base, name)
