"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words
are lower-cased. Windows of ``WINDOW`` template words are hashed, and so are their words, in
lower case, as they stand; a document's windows are joined by either hash with those of the
benchmark's items. Where a window's words differ behind the placeholders, the slots are
checked: within one alignment of a document and an item each value of the item must stand
for one value of the document, and the reverse. So a question asked again with other numbers
or names is met, as is a copy in other letter case, and a chance meeting of templates isn't.
A document is contaminated by an item if it holds at least ``CONTAINED`` of the item's
windows.

Such a document holds at least one of any part of the item's windows that is larger than
what may be missing. So candidates come from the item's rarest windows alone, and phrases
that many items share don't multiply documents with items.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common, textkit

U = textkit.U
WINDOW = 5
CONTAINED = 0.8
#: Item windows looked for in one pass over the documents; more make more passes.
BLOCK = 8_000_000
#: Bits of the sieve that documents' windows pass before they are joined: at least, at most (16 MB).
SIEVE = (20, 27)
#: A window with fewer plain words keeps its values, else it would say nothing.
PLAIN = 2
UNITS = """m cm mm km kg g mg t lb lbs oz ml cl l s ms min h hr hrs hz kb mb gb tb mph kph
metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet
inch inches yard yards gram grams kilogram kilograms kilo kilos pound pounds ounce ounces
litre litres liter liters gallon gallons second seconds minute minutes hour hours day days
week weeks month months year years dollar dollars cent cents euro euros percent degree
degrees celsius fahrenheit watt watts volt volts joule joules newton newtons usd eur gbp""".split()
NAMES = """alice bob carol carlos dave david emma john mary james robert michael william
linda susan sarah karen lisa nancy daniel matthew anthony mark paul steven andrew joshua
kevin brian george edward peter tom tim jack sam ben max anna maria jane janet julia laura
natalia weng betty julie ken mia olivia noah liam ava sophia lucas henry oliver""".split()
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x3A, 0x0A]] = True
PLAIN_WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_TYPED = textkit.mix(common.odd(21, 4))


def _solid(x: np.ndarray) -> np.ndarray:
    """Letters, digits, other bytes of UTF-8, and a point or comma between two digits."""
    digit = _DIGIT[x]
    inner = np.zeros(len(x), bool)
    inner[1:-1] = ((x[1:-1] == 0x2E) | (x[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    return _ALNUM[x] | inner


_known: dict[str, np.ndarray] = {}


def _listed(which: str, hashes: np.ndarray) -> np.ndarray:
    if not _known:
        for name, words in (("units", UNITS), ("names", NAMES)):
            _known[name] = np.sort(textkit.Words([w.encode() for w in words], solid=_solid).hash)
    return np.isin(hashes, _known[which])


class Templates:
    """The words of some texts with their kinds and template hashes."""

    def __init__(self, texts: list[bytes]):
        self.words = w = textkit.Words(texts, solid=_solid)
        x, n = w.buffer, len(w.start)
        self.kind = kind = np.zeros(n, np.int8)
        if n:
            digits = np.append(0, np.cumsum(_DIGIT[x]))
            marks = np.append(0, np.cumsum((x == 0x2E) | (x == 0x2C)))
            inside = lambda t: t[w.end] - t[w.start]
            number = (inside(digits) > 0) & (inside(digits) + inside(marks) == w.end - w.start)
            stops = np.append(0, np.cumsum(_STOP[x]))
            head = np.ones(n, bool)  # begins a sentence
            head[1:] = (stops[w.start[1:]] - stops[w.end[:-1]] > 0) | (w.text[1:] != w.text[:-1])
            first, second = x[w.start], x[np.minimum(w.start + 1, len(x) - 1)]
            capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            kind[(capital & ~head) | (capital & _listed("names", w.hash))] = NAME
            kind[number] = NUMBER
            after = np.zeros(n, bool)
            after[1:] = number[:-1] & (w.text[1:] == w.text[:-1])
            kind[after & ~number & _listed("units", w.hash)] = UNIT
        self.hash = np.where(kind > 0, _TYPED[kind], w.hash)

    def windows(self, size: int):
        """(hash, raw, at, text): hashed templates and words of each ``size`` words in a row.

        A template with few plain words is the words themselves. at: number of its first word.
        """
        w = self.words
        count = np.maximum(np.diff(w.first) - size + 1, 0)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
        mixers = textkit.mix(common.odd(22, size))
        raw, hashed, plain = np.zeros(len(at), U), np.zeros(len(at), U), np.zeros(len(at), np.int64)
        for j in range(size):
            raw += w.hash[at + j] * mixers[j]
            hashed += self.hash[at + j] * mixers[j]
            plain += self.kind[at + j] == PLAIN_WORD
        raw, hashed = textkit.mix(raw + U(size)), textkit.mix(hashed + U(size))
        return np.where(plain < min(PLAIN, size), raw, hashed), raw, at, np.repeat(np.arange(len(count)), count)

    def slots(self, at: np.ndarray, size: int) -> pa.Array:
        """The values behind each window's placeholders."""
        where = at[:, None] + np.arange(size)
        slot = self.kind[where] > 0 if len(at) else np.zeros((0, size), bool)
        values = self.words.hash[where][slot] if len(at) else np.zeros(0, U)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(slot.sum(1))).astype(np.int32), pa.array(values.view(np.int64)))


def _windows(df: DataFrame, sizes: list[int] | None, sieve: np.ndarray | None, window: int) -> DataFrame:
    """id, rid, size, place, total, hash, raw, slots for windows of df (id, rid, text).

    A window has a row for its template's hash and, where that differs, one for its words'.
    sizes None: each text's own size: the window, or its number of words if it has fewer.
    sieve: only hashes that pass it: packed bits, by the hash's first bits.
    """
    kind = df.schema["id"].dataType.simpleString()
    sizes = sizes if sizes is None else sorted(sizes)

    def make(batches):
        bits = None if sieve is None else np.unpackbits(sieve).view(bool)
        shift = None if sieve is None else U(64 - int(np.log2(len(bits))))
        for batch in batches:
            texts = textkit.as_bytes(batch.column(2))
            for a, b in textkit.chunks(texts):
                t = Templates(texts[a:b])
                n = np.diff(t.words.first)
                for size in sizes if sizes is not None else range(1, window + 1):
                    hashed, raw, at, of = t.windows(size)
                    for which in (hashed, raw):
                        new = np.ones(len(raw), bool) if which is hashed else raw != hashed
                        use = np.flatnonzero(new & (bits[which >> shift] if bits is not None else np.minimum(n[of], window) == size))
                        text, m = of[use], len(use)
                        take = pa.array(text + a)
                        yield pa.record_batch(
                            [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(m, size, np.int32)), pa.array(at[use] - t.words.first[text]), pa.array(np.maximum(n[text] - size + 1, 0)), pa.array(which[use].view(np.int64)), pa.array(raw[use].view(np.int64)), t.slots(at[use], size)],
                            ["id", "rid", "size", "place", "total", "hash", "raw", "slots"],
                        )

    return map_in_arrow(df.select("id", "rid", "text"), make, f"id {kind}, rid long, size int, place long, total long, hash long, raw long, slots array<long>")


def _sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """Packed bits, set where one of n hashes begins with the bit's number."""
    width = min(max(SIEVE[0], int(n).bit_length() + 4), SIEVE[1])
    first = hashes.select(F.shiftrightunsigned("hash", 64 - width).cast("int").alias("f")).distinct().toArrow()  # n numbers of 32 bits at most
    bits = np.zeros(1 << width, bool)
    bits[first["f"].to_numpy()] = True
    return np.packbits(bits)


def _both(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns, nulls being equal; b's are dropped."""
    b = b.select(*(F.col(c).alias(f"{c}__") if c in columns else F.col(c) for c in b.columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return a.join(b, same, how).drop(*(f"{c}__" for c in columns))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, contained: float = CONTAINED, block: int = BLOCK) -> DataFrame:
    """doc_id, rid, item_id, n_windows, n_found, containment: each contaminated document and item.

    docs: doc_id, text; benchmark: item_id, text; other columns are left alone. rid is the
    document's xxhash64(text), which tells apart rows that share a doc_id. Null and empty
    texts have no windows and take no part; null ids are ids like others. An item of fewer
    words than the window is one window. Repeated rows of documents or items count once.
    A text is whole in one task, however long. Nothing is found in, or with, an empty table.
    """
    items = benchmark.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("rid"), "text").distinct()
    theirs = _windows(items, None, None, window).withColumnsRenamed({"id": "item_id", "rid": "item_rid"})
    theirs = common.written(theirs, "items", n=F.approx_count_distinct("hash"), sizes=F.collect_set("size"))  # at most `window` sizes
    passes = max(1, -(-theirs.counts["n"] // block))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("rid"), "text")
    found = []
    for i in range(passes):
        part = theirs.select("hash").distinct().where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == i)
        found.append(_windows(rows, theirs.counts["sizes"], _sieve(part, theirs.counts["n"] // passes), window))
    ours = functools.reduce(DataFrame.union, found).select(F.col("id").alias("doc_id"), "rid", "size", F.col("place").alias("at"), "hash", F.col("raw").alias("own"), F.col("slots").alias("values"))
    doc, item = ["doc_id", "rid"], ["item_id", "item_rid"]
    wanted = common.written(theirs.select("hash", "size").distinct(), "wanted")
    ours = common.written(ours.join(common.beside(wanted), ["hash", "size"], "left_semi").distinct(), "found")
    # Each place of an item once, with the number of items that share its commonest hash.
    shared = theirs.groupBy("hash", "size").agg(F.countDistinct("item_id", "item_rid").alias("items"))
    places = theirs.join(shared, ["hash", "size"]).groupBy(*item, "place", "total").agg(F.max("items").alias("items"))
    missing = F.col("total") - F.ceil(F.lit(contained) * F.col("total") - 1e-9)
    rank = F.row_number().over(W.partitionBy(*item).orderBy("items", "place"))
    rare = places.withColumn("rank", rank).where(F.col("rank") <= missing + 1).select(*item, "place")
    keys = common.written(_both(theirs.select("hash", "size", *item, "place"), rare, [*item, "place"], "left_semi").select("hash", "size", *item).distinct(), "keys")
    candidates = common.written(ours.join(common.beside(keys), ["hash", "size"]).select(*doc, *item).distinct(), "candidates")
    every = _both(candidates, theirs.select(*item, "size", "place", "total", "hash", "raw", "slots"), item)
    met = _both(every, ours, [*doc, "hash", "size"])
    met = common.written(met.withColumn("shift", F.col("at") - F.col("place")), "met")
    # Slots that an alignment fills inconsistently: a value that stands for two.
    key = [*doc, *item]
    pairs = met.select(*key, "shift", F.explode(F.arrays_zip("slots", "values")).alias("z")).select(*key, "shift", F.col("z.slots").alias("a"), F.col("z.values").alias("b")).distinct()
    judged = pairs.groupBy(*key, "shift").agg((F.count("*") == F.countDistinct("a")).alias("one"), (F.count("*") == F.countDistinct("b")).alias("back"))
    bad = judged.where("not (one and back)").select(*key, "shift", F.lit(True).alias("bad"))
    good = _both(met, bad, [*key, "shift"], "left").where("bad is null or raw = own").select(*key, "place", "total")
    counted = good.distinct().groupBy(*key, "total").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= contained * F.col("total"))
    out = counted.groupBy("doc_id", "rid", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("total"), "n_found", "total")).alias("m"))
    out = common.written(out.select("doc_id", "rid", "item_id", F.col("m.total").alias("n_windows"), F.col("m.n_found").alias("n_found"), (F.col("m.n_found") / F.col("m.total")).alias("containment")), "hits")
    common.drop(theirs, wanted, ours, keys, candidates, met)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; all columns and other rows stay."""
    bad = common.written(hits(docs, benchmark).select(F.col("doc_id").alias("d_"), F.col("rid").alias("r_")).distinct(), "leaks")
    bad = common.beside(bad)
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["d_"]) & (F.xxhash64(docs.text) == bad["r_"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents against the whole benchmark; one row for each contaminated document and item."""
    return hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("rid")
