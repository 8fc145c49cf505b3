"""Line dedup: drop lines that repeat an earlier line up to the edit of one word.

Lines with a word take part; ASCII case and spacing don't count. A line goes if an earlier
line (by doc_id, then line number) is equal, or turns into it when one word is inserted,
deleted or substituted and both have ``NEAR_WORDS`` words or more: one edit among five
words leaves four fifths as they were. Of equal or near-equal lines the earliest stays.

Near-equal lines are met in the deletion neighbourhood: a line emits, as hashed keys,
itself and each variant with one word deleted. Two lines that differ by a deleted word
share the shorter one's own key; two that differ by a substitution share the key of the
same variant at the same place. To keep this small, only lines that share a half with
another line emit variants. That loses nothing: one edit leaves one of the two halves as
it was. Each match is verified on the words themselves. A key's group yields its earliest
members only, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common, textkit

U = textkit.U
#: Least number of words of lines that are compared up to an edit; equal lines meet at any length.
NEAR_WORDS = 5
#: Tasks over which the lines near one earlier line are spread.
SPREAD = 64
_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
SELF, DELETED, REPLACED = 0, 1, 2


def _position():
    """A line's position: by document, then by line; documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "line")


class _Lines:
    """Lines of some texts, with hashes of any run of their words."""

    def __init__(self, texts: list[bytes]):
        split = [t.split(b"\n") for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.of = np.repeat(np.arange(len(texts)), self.count)
        self.number = np.arange(len(self.of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.lines = [x for y in split for x in y]
        words = textkit.Words(self.lines, b"\n")
        self.start, self.end = words.first[:-1], words.first[1:]
        self.n = self.end - self.start
        self.words = words.hash
        size = len(words.hash) + 1
        self.power = np.full(size, _BASE, U)
        self.inverse = np.full(size, _INVERSE, U)
        self.power[0] = self.inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(self.power), np.multiply.accumulate(self.inverse)
        self.total = np.zeros(size, U)
        np.cumsum(words.hash * self.power[:-1], out=self.total[1:])

    def run(self, start, end):
        """Hash of the words from start to end, not yet mixed."""
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def keys(self, start, end, kind: int):
        return textkit.mix(self.run(start, end) + (end - start).astype(U) * U(2 * kind + 1))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, rid, text: rid tells apart texts that share a doc_id."""
    return docs.select("doc_id", F.xxhash64("text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, rid, line, h, halves: every line with a word.

    h: hash of its words; halves: of lines with NEAR_WORDS words, hashes of the first and last half; where the number of
    words is odd, the middle word belongs to either, so lines of n and n + 1 words meet.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            texts = textkit.as_bytes(batch.column(2))
            for a, b in textkit.chunks(texts):
                x = _Lines(texts[a:b])
                at = np.flatnonzero(x.n)
                s, e, n = x.start[at], x.end[at], x.n[at]
                halves = np.stack([x.keys(s, s + n // 2, 1), x.keys(s, s + (n - 1) // 2, 1), x.keys(e - (n + 1) // 2, e, 2), x.keys(e - n // 2, e, 2)], 1)
                even = n % 2 == 0  # one of the four is there twice
                use = np.ones(halves.shape, bool)
                use[even, 3] = False
                use[~even, 1] = False
                use[n < NEAR_WORDS] = False
                first = np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)
                take = pa.array(x.of[at] + a)
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(x.number[at].astype(np.int32)), pa.array(x.keys(s, e, 0).view(np.int64)), pa.ListArray.from_arrays(first, pa.array(halves[use].view(np.int64)))],
                    ["doc_id", "rid", "line", "h", "halves"],
                )

    return map_in_arrow(_rows(docs), make, f"doc_id {kind}, rid long, line int, h long, halves array<long>")


def variants(docs: DataFrame) -> DataFrame:
    """key, kind, place, h, line, text from docs (doc_id, rid, text, lines): the neighbourhood of those lines.

    place: which word is missing. The text comes with kind SELF only.
    """

    def make(batches):
        for batch in batches:
            texts = textkit.as_bytes(batch.column(2))
            wanted = batch.column(3)
            for a, b in textkit.chunks(texts, 1 << 17):
                x = _Lines(texts[a:b])
                mark = np.zeros(len(x.of), bool)
                begin = np.cumsum(x.count) - x.count
                for i in range(a, b):
                    mark[begin[i - a] + np.array(wanted[i].as_py(), np.int64)] = True
                at = np.flatnonzero(mark)
                s, e, n = x.start[at], x.end[at], x.n[at]
                h = x.keys(s, e, 0)
                row = np.repeat(np.arange(len(at)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                p = s[row] + place
                rest = x.run(s[row], p) + (x.total[e[row]] - x.total[p + 1]) * x.inverse[s[row]] * _INVERSE
                gone = textkit.mix(rest + (n[row] - 1).astype(U))
                swap = textkit.mix(gone ^ textkit.mix(place.astype(U) * U(1 << 32) + n[row].astype(U)))
                m = len(at)
                key = np.concatenate([h, gone, swap]).view(np.int64)
                what = np.concatenate([np.full(m, SELF), np.full(len(row), DELETED), np.full(len(row), REPLACED)]).astype(np.int32)
                own = pa.array([x.lines[i].decode() for i in at.tolist()], pa.string())
                where = np.concatenate([np.arange(m), np.full(2 * len(row), -1)])
                yield pa.record_batch(
                    [pa.array(key), pa.array(what), pa.array(np.concatenate([np.zeros(m, np.int64), place, place]).astype(np.int32)), pa.array(np.concatenate([h, h[row], h[row]]).view(np.int64)), own.take(pa.array(where, mask=where < 0))],
                    ["key", "kind", "place", "h", "text"],
                )

    return map_in_arrow(docs.select("doc_id", "rid", "text", "lines"), make, "key long, kind int, place int, h long, text string")


def _words(column: str):
    """A line's words, ASCII letters lower-cased."""
    folded = F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(words, place):
    return F.concat(F.slice(words, 1, place), F.slice(words, place + 2, F.size(words)))


def repeated(docs: DataFrame) -> DataFrame:
    """d_, r_, dropped_: of each document (doc_id, rid) that loses lines, their numbers in order."""
    all_ = common.written(lines(docs), "lines")
    first = common.written(all_.groupBy("h").agg(F.min(_position()).alias("pos")), "first")
    halves = all_.select("h", F.explode("halves").alias("half"))
    shared = common.written(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"), "halves")
    some = halves.join(common.beside(shared), "half", "left_semi").select("h").distinct()
    some = first.join(some, "h").select("pos.doc_id", "pos.rid", "pos.line").groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    some = common.written(some.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "lines"), "some")
    rows = _rows(docs)
    there = rows.join(common.beside(some), rows.doc_id.eqNullSafe(F.col("d")) & (rows.rid == F.col("r")))
    near = common.written(variants(there), "variants")
    groups = common.written(near.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"), "keys")
    met = common.written(near.join(common.beside(groups), "key", "left_semi").select("key", "kind", "place", "h").join(first, "h"), "met")
    who = F.struct("pos", "h", "place")
    least = met.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, who)).alias(f"least{k}") for k in (SELF, DELETED, REPLACED)))
    other = F.when(F.col("kind") == SELF, F.col(f"least{DELETED}")).when(F.col("kind") == DELETED, F.col(f"least{SELF}")).otherwise(F.col(f"least{REPLACED}"))
    found = met.join(least, "key").withColumn("o", other).where("o.h <> h and o.pos < pos")
    found = found.select("h", "kind", "place", F.col("o.h").alias("oh"), F.col("o.place").alias("oplace"), F.pmod(F.xxhash64("h"), F.lit(SPREAD)).alias("salt")).distinct()
    found = common.written(found, "found")
    text = near.where(F.col("kind") == SELF).select("h", _words("text").alias("w")).dropDuplicates(["h"])
    # An earlier line may have any number of others near it: its words go to SPREAD places at most, and meet a part of them in each.
    its_words = found.select("oh", "salt").distinct().join(text.select(F.col("h").alias("oh"), F.col("w").alias("ow")), "oh")
    checked = found.join(text, "h").join(its_words, ["oh", "salt"])
    mine = F.when(F.col("kind") == SELF, F.col("w")).otherwise(_without(F.col("w"), F.col("place")))
    its = F.when(F.col("kind") == DELETED, F.col("ow")).otherwise(_without(F.col("ow"), F.col("oplace")))
    same = (mine == its) & ((F.col("kind") != REPLACED) | (F.col("place") == F.col("oplace")))
    late = checked.where(same).select("h").distinct().withColumn("late", F.lit(True))
    info = common.written(first.join(late, "h", "left"), "lineinfo")  # a join of its own, so that a line that is everywhere can be split
    gone = all_.select("doc_id", "rid", "line", "h").join(info, "h").where(F.col("late") | (_position() != F.col("pos"))).select("doc_id", "rid", "line")
    gone = common.written(gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("line")).alias("dropped")).select(F.col("doc_id").alias("d_"), F.col("rid").alias("r_"), F.col("dropped").alias("dropped_")), "dropped")
    common.drop(all_, first, shared, some, near, groups, met, found, info)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped for every row of docs (doc_id, text).

    dropped: the numbers (from 0, ascending) of the lines that go. A null text is empty; an
    empty text is one empty line; lines without words stay. Lines and texts of any length are
    whole in one row. Rows with the same
    doc_id and text are one occurrence and lose the same lines; a null doc_id ranks last.
    Other columns are left alone; an empty table gives no rows.
    """
    gone = repeated(docs)
    rows = _rows(docs).select("doc_id", "rid", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    out = rows.join(gone, rows.doc_id.eqNullSafe(gone.d_) & (rows.rid == gone.r_), "left")
    dropped = F.coalesce("dropped_", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a document that had words and loses all of them goes.

    All columns stay; n_chars, if there, is counted anew for a text that changed.
    """
    gone = repeated(docs)
    both = docs.join(gone, docs.doc_id.eqNullSafe(gone["d_"]) & (F.xxhash64(docs["text"]) == gone["r_"]), "left")
    dropped, text = gone["dropped_"], docs["text"]
    new = F.when(dropped.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(dropped, i)), "\n"))
    both = both.where(dropped.isNull() | new.rlike(r"[^\x20\x09-\x0D]"))
    out = [new.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if "n_chars" in docs.columns:
        changed = F.when(dropped.isNull(), docs["n_chars"]).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
        out = [changed.alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)]
    return both.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the lines of all documents; dropped is comma-joined."""
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.withColumn("dropped", F.array_join("dropped", ","))
