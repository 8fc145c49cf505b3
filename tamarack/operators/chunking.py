"""From file texts to chunk records: windows for any text, syntax for Python.

Only code that is split along syntax crosses into Python workers; everything else is cut,
cleaned and checked inside the plan.
"""

from __future__ import annotations

import ast
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CODE, LANGUAGES, Config, check_window
from ..functions import text as T
from ..session import map_in_arrow


def cut(text: str, size: int, overlap: int) -> list[str]:
    """The same windows as functions.text.windows."""
    check_window(size, overlap)
    out, at, n = [], 0, len(text)
    while at < n:
        out.append(text[at : at + size])
        if at + size >= n:
            break
        at += size - overlap
    return out


class PythonChunker:
    """Top-level definitions and statements; classes too large are split by member.

    Imports are left out, as are decorators unless asked for. A file that doesn't parse, or
    yields nothing, is cut into windows.
    """

    def __init__(self, size: int, overlap: int, keep_imports: bool = False, keep_decorators: bool = False):
        check_window(size, overlap)
        self.size, self.overlap = size, overlap
        self.keep_imports, self.keep_decorators = keep_imports, keep_decorators

    def _lines(self, node, lines: list[str]) -> str:
        first = node.lineno
        if self.keep_decorators and getattr(node, "decorator_list", None):
            first = min(d.lineno for d in node.decorator_list)
        return "".join(lines[first - 1 : node.end_lineno])

    def _fit(self, text: str) -> list[str]:
        return [text] if len(text) <= self.size else cut(text, self.size, self.overlap)

    def _members(self, node: ast.ClassDef, lines: list[str]):
        head = "".join(lines[node.lineno - 1 : node.body[0].lineno - 1])
        for member in node.body:
            own = self._lines(member, lines)
            if isinstance(member, ast.FunctionDef | ast.AsyncFunctionDef):
                whole = f"{head}\n    # ... (other methods)\n\n{own}"
                yield from [whole] if len(whole) <= self.size else self._fit(own)
            elif own.strip():
                whole = f"{head}\n{own}"
                yield from [whole] if len(whole) <= self.size else cut(own, self.size, self.overlap)

    def __call__(self, code: str) -> list[tuple[str, str, str | None, int | None, int | None]]:
        """(chunk, kind, name, first line, last line) of each chunk."""
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [(c, "window", None, None, None) for c in cut(code, self.size, self.overlap)]
        lines = code.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines = [f"{x}\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        out = []
        for node in tree.body:
            if isinstance(node, ast.Import | ast.ImportFrom) and not self.keep_imports:
                continue
            own = self._lines(node, lines)
            kind = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}.get(type(node), "statement")
            if not own.strip():
                continue
            split = self._members(node, lines) if kind == "class" and len(own) > self.size else self._fit(own)
            out += [(c, kind, getattr(node, "name", None), node.lineno, node.end_lineno) for c in split]
        return out or [(c, "window", None, None, None) for c in cut(code, self.size, self.overlap)]


#: Chunkers by language; an entry is a function of (size, overlap) that gives a function of the code.
CHUNKERS = {"python": PythonChunker}


def by_syntax(files: DataFrame, config: Config = Config(), chunkers: dict | None = None) -> DataFrame:
    """source, file_hash, chunk_index, chunk, kind, name, start_line, end_line of files (source, file_hash, text).

    A language without a chunker, and any failure of one, gives windows.
    """
    chunkers, size, overlap = dict(CHUNKERS if chunkers is None else chunkers), config.chunk_size, config.overlap
    names = ["source", "file_hash", "chunk_index", "chunk", "kind", "name", "start_line", "end_line"]

    def run(batches):
        made = {k: f(size, overlap) for k, f in chunkers.items()}
        for batch in batches:
            rows = []
            for source, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                chunker = made.get(LANGUAGES.get(os.path.splitext(source)[1].lower(), "unknown"))
                try:
                    found = chunker(text) if chunker else None
                except Exception:  # noqa: BLE001  a chunker that fails on a file must not stop the others
                    found = None
                if found is None:
                    found = [(c, "window", None, None, None) for c in cut(text, size, overlap)]
                rows += [(source, digest, i, *c) for i, c in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_in_arrow(files.select("source", "file_hash", "text"), run, "source string, file_hash string, chunk_index int, chunk string, kind string, name string, start_line int, end_line int")


def by_windows(files: DataFrame, config: Config = Config()) -> DataFrame:
    """The same columns, by windows alone and without Python."""
    cut_ = F.posexplode(T.windows(F.col("text"), config.chunk_size, config.overlap)).alias("chunk_index", "chunk")
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    return files.select("source", "file_hash", cut_).select("*", F.lit("window").alias("kind"), none("name", "string"), none("start_line", "int"), none("end_line", "int"))


def raw_chunks(files: DataFrame, config: Config = Config(), syntax: bool = True) -> DataFrame:
    """Chunks of files with a text that isn't blank; code by syntax if asked for."""
    files = files.where(T.not_blank(F.col("text")))
    if not syntax:
        return by_windows(files, config)
    code = T.extension(F.col("source")).isin(sorted(CODE))
    return by_syntax(files.where(code), config).unionByName(by_windows(files.where(~code), config))


def judged(chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """id, source, chunk_index, document, file_hash, reason: with path header, sanitised; reason is null if valid."""
    document = T.sanitize(T.with_header(F.col("source"), F.col("chunk")))
    done = chunks.withColumn("document", document)
    return done.select(T.chunk_id(F.col("source"), F.col("chunk_index")).alias("id"), "source", "chunk_index", "document", "file_hash", T.invalid_reason(F.col("document"), config.max_chunk_length).alias("reason"))


def records(files: DataFrame, config: Config = Config(), syntax: bool = True) -> DataFrame:
    """The valid chunks of files, ready to be embedded; indices of rejected chunks are left free."""
    return judged(raw_chunks(files, config, syntax), config).where("reason is null").drop("reason")


def counters(judged_: DataFrame) -> DataFrame:
    """files, chunks, failed: one row."""
    return judged_.agg(F.countDistinct("source").alias("files"), F.count(F.when(F.col("reason").isNull(), 1)).alias("chunks"), F.count("reason").alias("failed"))
