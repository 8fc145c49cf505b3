"""Edges between files: extraction by language plug-ins, replacement by source, bounded paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow

EDGES = "src string, dst string, edge_type string, weight double"
KINDS = ("IMPORTS", "INVOKES", "INHERITS", "REFERENCES", "CONTAINS")

Edge = tuple[str, str, float]


class JavaPlugin:
    """Imports, supertypes, calls and field types by regular expressions; targets are names, resolved later."""

    extensions = (".java",)
    _import = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", re.M)
    _super = re.compile(r"\b(?:class|interface|record|enum)\s+\w+(?:<[^{]*?>)?\s*((?:extends|implements)[^{]*)\{")
    _call = re.compile(r"\bnew\s+([A-Z]\w*)|\b([A-Z]\w*)\s*\.\s*\w+\s*\(")
    _field = re.compile(r"^\s*(?:private|protected|public)\s+(?:static\s+)?(?:final\s+)?([A-Z]\w*)(?:<[^;=(]*>)?\s+\w+\s*[;=]", re.M)

    def extract_edges(self, path: str, text: str) -> Iterable[Edge]:
        for m in self._import.finditer(text):
            yield m[1], "IMPORTS", 1.0
        for m in self._super.finditer(text):
            for name in re.findall(r"[A-Z]\w*", re.sub(r"<[^<>]*>", "", m[1])):
                yield name, "INHERITS", 1.0
        for m in self._call.finditer(text):
            yield m[1] or m[2], "INVOKES", 1.0
        for m in self._field.finditer(text):
            yield m[1], "CONTAINS", 1.0


class TypeScriptPlugin:
    extensions = (".ts", ".tsx")
    _import = re.compile(r"""\b(?:import|export)\b[^'";]*?\bfrom\s*['"]([^'"]+)['"]|\bimport\s*\(?\s*['"]([^'"]+)['"]""")
    _super = re.compile(r"\b(?:class|interface)\s+\w+(?:<[^{]*?>)?\s*((?:extends|implements)[^{]*)\{")
    _call = re.compile(r"\bnew\s+([A-Z]\w*)|\b([A-Z]\w*)\s*\.\s*\w+\s*\(")
    _field = re.compile(r"\b(?:private|protected|public|readonly)\s+\w+\s*[?!]?:\s*([A-Z]\w*)")

    def extract_edges(self, path: str, text: str) -> Iterable[Edge]:
        for m in self._import.finditer(text):
            target = m[1] or m[2]
            yield os.path.normpath(os.path.join(os.path.dirname(path), target)).replace(os.sep, "/") if target.startswith(".") else target, "IMPORTS", 1.0
        for m in self._super.finditer(text):
            for name in re.findall(r"[A-Z]\w*", re.sub(r"<[^<>]*>", "", m[1])):
                yield name, "INHERITS", 1.0
        for m in self._call.finditer(text):
            yield m[1] or m[2], "INVOKES", 1.0
        for m in self._field.finditer(text):
            yield m[1], "CONTAINS", 1.0


class HtmlPlugin:
    """References to other files and custom elements, less certain than code."""

    extensions = (".html",)
    _link = re.compile(r"""\b(?:href|src|routerLink|templateUrl)\s*=\s*["']([^"'#?]+)""", re.I)
    _element = re.compile(r"<([a-z]+-[\w-]+)")

    def extract_edges(self, path: str, text: str) -> Iterable[Edge]:
        for m in self._link.finditer(text):
            yield m[1], "REFERENCES", 0.7
        for m in self._element.finditer(text):
            yield m[1], "REFERENCES", 0.7


class Registry:
    """Plug-ins by extension, in any case; the last that is registered counts."""

    def __init__(self, plugins=()):
        self._by: dict[str, object] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin) -> None:
        for ext in plugin.extensions:
            self._by[ext.lower()] = plugin

    def get(self, extension: str):
        return self._by.get(extension.lower())


def default_registry() -> Registry:
    return Registry([JavaPlugin(), TypeScriptPlugin(), HtmlPlugin()])


def extract_edges(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """src, dst, edge_type, weight of files (source, text); a plug-in that fails gives no edges."""
    registry = registry or default_registry()

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plugin = registry.get(os.path.splitext(path)[1]) if path else None
                if plugin is not None and text:
                    try:
                        rows += [(path, *e) for e in dict.fromkeys(plugin.extract_edges(path, text))]
                    except Exception:  # noqa: BLE001  the contract of plug-ins: never raise
                        continue
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["src", "dst", "edge_type", "weight"])

    return map_in_arrow(files.select("source", "text"), run, EDGES)


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with dst replaced by a file's path where a name, path or qualified name fits; ``resolved`` tells."""
    stem = F.regexp_replace("source", r"\.[^./]*$", "")
    keys = F.array_distinct(F.array("source", stem, F.element_at(F.split(stem, "/"), -1)))
    known = files.select("source", F.explode(keys).alias("key")).groupBy("key").agg(F.min("source").alias("file"))
    dotted = F.regexp_replace("dst", r"\.", "/")
    names = edges.withColumn("last_", F.element_at(F.split("dst", r"[./]"), -1)).withColumn("dotted_", dotted)
    full = known.select(F.col("key").alias("dst"), F.col("file").alias("f1"))
    last = known.select(F.col("key").alias("last_"), F.col("file").alias("f2"))
    found = names.join(full, "dst", "left").join(last, "last_", "left")
    to = F.coalesce("f1", "f2")
    return found.select("src", F.coalesce(to, "dst").alias("dst"), "edge_type", "weight", to.isNotNull().alias("resolved"))


def replace_edges(edges: DataFrame, sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges without those that start in sources (source), and the fresh ones."""
    return edges.join(sources.select(F.col("source").alias("src")), "src", "left_anti").select("src", "dst", "edge_type", "weight").unionByName(fresh)


def bounded_paths(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, cost: str = "weight") -> DataFrame:
    """node, distance, hops: the least cost from any seed (node) within max_hops edges.

    One equi-join and one aggregation a hop; a node's best distance so far is kept, so
    cycles do no harm. cost: weight (as stored), unit or inverse (1 / weight).
    """
    price = {"weight": F.col("weight"), "unit": F.lit(1.0), "inverse": 1 / F.col("weight")}[cost]
    out = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(price).alias("cost"))
    best = seeds.select("node").distinct().select("node", F.lit(0.0).alias("distance"), F.lit(0).alias("hops"))
    front = best
    for hop in range(1, max_hops + 1):
        front = front.join(out, front.node == out.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("distance")).withColumn("hops", F.lit(hop))
        best = best.unionByName(front).groupBy("node").agg(F.min(F.struct("distance", "hops")).alias("b")).select("node", "b.distance", "b.hops")
    return best
