"""Packing tokenised documents into sequences of a fixed length.

Shortest-pack-first over the length histogram: documents are cut into pieces of at most
``size`` tokens; only the histogram of piece lengths (at most ``size`` numbers, whatever
the corpus) reaches the driver, where lengths are placed longest first, each into the pack
that holds least so far. The outcome is a list of packing patterns with counts; pieces
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common

SIZE = 2048
END_ID = 1
#: White space that isn't one space or line feed between two other characters.
_ODD = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")
SPECIAL = "<|endoftext|>"
CACHED = 200_000


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The pre-tokeniser always breaks before a single space and around a single line feed,
    so texts are split there and each part's ids are looked up; the dictionary holds the
    first ``CACHED`` parts met. Texts with other white space are encoded in one go. The
    ids are those of the tokenizers library (a test compares them).
    """

    def __init__(self, tokenizer: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(tokenizer or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = np.array([len(ranks)], "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self._ids(part if part[:1] == "\n" else f" {part}")
        if len(self) < CACHED and len(part) < 64:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text; the special token's string counts as that token."""
        if SPECIAL in text:
            return self.special.join(self.ids(x) for x in text.split(SPECIAL))
        if not text:
            return b""
        if _ODD.search(text):
            return self._ids(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        return self._ids(head) + b"".join(map(self.__getitem__, rest))


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut into pieces.

    A document is cut from its start into pieces of ``size`` and what remains. A null text
    is empty and consists of the end id alone.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                rows += [(key, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    return map_in_arrow(docs.select("doc_id", "text"), cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, copies), ...]) for a histogram of lengths.

    Lengths go longest first; each is placed into the packs with the least in them that
    still have room, one copy a pack, and only then opens new packs. All packs of one
    make are moved together, so the work depends on the number of lengths, not of pieces.
    """
    open_: list[tuple[int, int, int, tuple]] = []  # (tokens so far, tie, packs, runs)
    done: list[tuple[int, tuple]] = []
    tie = 0
    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left and open_ and open_[0][0] + length <= size:
            used, _, packs, runs = heapq.heappop(open_)
            take = min(left, packs)
            left -= take
            if take < packs:
                heapq.heappush(open_, (used, tie := tie + 1, packs - take, runs))
            grown = (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))
            if used + length < size:
                heapq.heappush(open_, (used + length, tie := tie + 1, take, grown))
            else:
                done.append((take, grown))
        each = size // length
        for packs, copies in ((left // each, each), (int(left % each > 0), left % each)):
            if packs:
                if copies * length < size:
                    heapq.heappush(open_, (copies * length, tie := tie + 1, packs, ((length, copies),)))
                else:
                    done.append((packs, ((length, copies),)))
    return [(n, list(runs)) for n, runs in [*done, *((p, r) for _, _, p, r in sorted(open_))]]


def places(packed: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, packs, offset): where the pieces of rank lo to hi - 1 go."""
    out, rank, sequence = [], {}, 0
    for packs, runs in packed:
        offset = 0
        for length, copies in runs:
            lo = rank.get(length, 0)
            rank[length] = hi = lo + packs * copies
            out.append((length, lo, hi, sequence, packs, offset))
            offset += length * copies
        sequence += packs
    return out


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str | None = None, salted: int = 500) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    docs: doc_id, text; other columns are left alone. Ranks are counted in parts: pieces of
    a length are dealt over salts, each of ``salted`` pieces or the square root of the length's
    pieces, if that is more. So neither the pieces of a salt nor the salts of a length, even
    of one that a third of the corpus shares, are too many for a task. A very long text is cut in one task.

    Null ids and repeated rows are packed like others; pieces that tie in every column are
    interchangeable. A null or empty text is the end id alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = common.written(pieces(docs, size, end_id, tokenizer), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    found = places(patterns(histogram, size))
    each = lambda n: -(-n // max(salted, math.isqrt(n)))
    salts = F.get(F.array(*(F.lit(each(histogram.get(n, 1))) for n in range(size + 1))), F.col("length").cast("int"))  # of each length
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("nth", F.row_number().over(order) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("below"))
    where = spark.createDataFrame(found, "length long, lo long, hi long, sequence long, packs long, at long")
    # `where` has one row a run of a pattern: its size depends on `size`, not on the corpus.
    here = ranked.join(F.broadcast(where), (ranked.length == where.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return here.select(
        "doc_id", "start", ranked.length.alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + nth % F.col("packs")).alias("sequence_id"),
        (F.col("at") + F.floor(nth / F.col("packs")) * ranked.length).alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents, packed."""
    return pack(common.table(spark, sf_dir, "documents"))
