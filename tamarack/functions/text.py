"""Column functions on paths, chunks and lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CODE, EXCLUDED, INDEXED, LANGUAGES, check_window


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of a name start none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^\.*[^.].*?(\.[^.]*)$", 1))


def indexable(path: Column, extensions=None) -> Column:
    return extension(path).isin(sorted(INDEXED if extensions is None else extensions))


def is_code(path: Column) -> Column:
    return extension(path).isin(sorted(CODE))


def language(path: Column) -> Column:
    """From the extension; ``unknown`` otherwise."""
    known = F.create_map(*(F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair))
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def in_excluded(path: Column, folders=None) -> Column:
    """Whether a folder of the path is excluded; names must be equal, at any depth."""
    folders = sorted(EXCLUDED if folders is None else folders)
    if not folders:
        return F.lit(False)
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, folders)))


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def windows(text: Column, size: int | Column = 800, overlap: int | Column = 200) -> Column:
    """Windows of ``size`` characters that begin every size - overlap; the last ends with the text.

    size and overlap may be columns, as in sweeps; those must come checked.
    """
    if not isinstance(size, Column):
        check_window(size, overlap)
        size, overlap = F.lit(size), F.lit(overlap)
    step, n = size - overlap, F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, size))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<string>"))


def with_header(source: Column, chunk: Column) -> Column:
    return F.concat(F.lit("// "), source, F.lit("\n"), chunk)


def sanitize(text: Column) -> Column:
    """Without control characters but tab, line feed and return; three line feeds in a row at most; stripped."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{4,}", "\n\n\n"), r"(?U)^\s+|\s+$", "")


def named(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it, and however filters are moved."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def invalid_reason(chunk: Column, longest: int = 8000) -> Column:
    """Why a chunk isn't stored: empty, too_long, null_bytes or unprintable; null if it is."""
    return named(chunk, lambda c: _invalid_reason(c, longest))


def _invalid_reason(chunk: Column, longest: int) -> Column:
    nulls = F.length(chunk) - F.length(F.regexp_replace(chunk, r"\x00", ""))
    printable = F.length(F.regexp_replace(chunk, r"(?![ \n\t\r])[\p{C}\p{Z}]", ""))
    return (
        F.when(~not_blank(chunk), "empty")
        .when(F.length(chunk) > longest, "too_long")
        .when(nulls > 10, "null_bytes")
        .when((F.length(chunk) > 100) & (printable / F.length(chunk) < 0.7), "unprintable")
    )


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(source, F.lit("::chunk_"), index.cast("string"))


def byte_size(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    """1536 -> 1.5 KB; the last unit takes whatever is larger."""
    of = lambda power, unit: F.format_string(f"%.1f {unit}", n / 1024.0**power)
    out = of(len(units) - 1, units[-1])
    for power, unit in reversed(list(enumerate(units[:-1]))):
        out = F.when(n < 1024 ** (power + 1), of(power, unit)).otherwise(out)
    return out


def listed(text: Column) -> Column:
    """Trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def safe_int(text: Column, default: int) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def padded(text: Column, least: int = 5100) -> Column:
    """A text repeated, parted by spaces, until it has at least so many characters."""
    one = F.concat(text, F.lit(" "))
    return F.when(F.length(text) >= least, text).otherwise(F.repeat(one, F.ceil(F.lit(least) / F.length(one)).cast("int")))


def enabled(settings: Column) -> Column:
    """How many values of a map are true."""
    return F.size(F.map_filter(settings, lambda _, v: v))


NAME = re.compile(r"[A-Za-z0-9_.-]+\Z")
