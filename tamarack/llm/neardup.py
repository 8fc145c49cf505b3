"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gives ``HASHES`` minima. The first of them make band
keys; of all only their low ``BITS`` bits are kept, packed into a few numbers. Documents that
share a band are candidates; the packed bits, compared by bit counts and corrected for
chance agreement, discard the hopeless ones, and exact Jaccard similarity on the full sets
confirms the others.

Copies are folded into one representative before anything is compared. For each candidate
the shingles that no other candidate has are counted; they bound its similarity with any
other, exactly, so large families of loosely similar texts fall away before they are
paired. In a band's bucket every member is first compared with two centres; what these
links connect needs no further comparison. Members that remain apart are then compared
with the members of other components in their bucket, so no candidate link that could join
two components is skipped, and what is linked is never expanded into all its pairs. A
bucket where many are apart is cut into parts of bounded work.

With 32 bands of 4 minima a pair at similarity 0.8 is missed with probability
(1 - 0.8^4)^32, about 5e-8. The estimate from 768 times two bits has a standard deviation
of 0.017 at 0.8; pairs are discarded below 0.72, 4.5 deviations away, and before that by the
same rule for the first quarter of the bits.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common, textkit

BANDS, ROWS = 32, 4
HASHES, BITS = 768, 2
#: Standard deviations below the least similarity at which pairs are discarded by their estimate.
DEVIATIONS = 4.5
_XOR, _TIMES = textkit.mix(common.odd(11, HASHES)), common.odd(12, HASHES)
_MIXERS = textkit.mix(common.odd(13, BANDS * ROWS)).reshape(BANDS, ROWS) | textkit.U(1)


def _signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of sets, none of them empty."""
    minima = np.empty((len(first) - 1, HASHES), np.uint64)
    for j in range(HASHES):
        minima[:, j] = np.minimum.reduceat((values ^ _XOR[j]) * _TIMES[j], first[:-1])
    bands = textkit.mix((minima[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * _MIXERS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    low = (minima >> textkit.U(20)) & textkit.U((1 << BITS) - 1)
    per = 64 // BITS
    packed = (low.reshape(-1, HASHES // per, per) << (np.arange(per, dtype=np.uint64) * textkit.U(BITS))).sum(2, dtype=np.uint64)
    return bands.view(np.int64), packed.view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, bands, bits: per document.

    set_a and set_b together tell sets apart. A document without words has neither bands
    nor bits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"]

    def sketch(batches):
        for batch in batches:
            texts = textkit.as_bytes(batch.column(1))
            for a, b in textkit.chunks(texts):
                words = textkit.Words(texts[a:b])
                values, first = textkit.distinct(*textkit.shingles(words.hash, words.first, k))
                size = np.diff(first)
                full = np.flatnonzero(size)
                begin = np.append(first[full], len(values))
                sums = np.zeros((2, b - a), np.int64)
                bands, bits = np.zeros((0, BANDS), np.int64), np.zeros((0, HASHES * BITS // 64), np.int64)
                if len(full):
                    bands, bits = _signatures(values, begin)
                    for i in (0, 1):
                        sums[i, full] = np.add.reduceat(textkit.mix(values + textkit.U(i)), begin[:-1]).view(np.int64)
                take = np.full(b - a, -1)
                take[full] = np.arange(len(full))
                where = pa.array(take, mask=take < 0)
                yield pa.record_batch([batch.column(0)[a:b], pa.array(size), pa.array(sums[0]), pa.array(sums[1]), _lists(bands).take(where), _lists(bits).take(where)], names)

    return map_in_arrow(docs.select("doc_id", "text"), sketch, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """id, set_a, values: the sorted distinct shingle hashes of each document, and their sum as in sketches()."""
    kind = docs.schema["id"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            texts = textkit.as_bytes(batch.column(1))
            for a, b in textkit.chunks(texts):
                words = textkit.Words(texts[a:b])
                values, first = textkit.distinct(*textkit.shingles(words.hash, words.first, k))
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values.view(np.int64)))
                full = np.flatnonzero(np.diff(first))
                sums = np.zeros(b - a, np.int64)
                if len(full):
                    sums[full] = np.add.reduceat(textkit.mix(values), first[full]).view(np.int64)
                yield pa.record_batch([batch.column(0)[a:b], pa.array(sums), lists], ["id", "set_a", "values"])

    return map_in_arrow(docs.select("id", "text"), make, f"id {kind}, set_a long, values array<long>")


def estimate(a: str, b: str, hashes: int = HASHES):
    """Similarity estimated from the low bits of the first so many hashes, in two columns of packed bits."""
    differ = F.lit(0)
    lanes = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)) - (1 << 64 if BITS == 1 else 0))
    for i in range(hashes * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_ = x
        for s in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_.bitwiseAND(lanes))
    return ((1 - differ / hashes) - CHANCE) / (1 - CHANCE)


#: Chance agreement of two hashes' low bits.
CHANCE = 1 / (1 << BITS)


def least_estimate(percent: int, hashes: int) -> float:
    """Below it, an estimate rules a pair out."""
    agree = CHANCE + (1 - CHANCE) * percent / 100
    return percent / 100 - DEVIATIONS * math.sqrt(agree * (1 - agree) / hashes) / (1 - CHANCE)


def _hopeful(full: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """id, n, own, bits: set size, shingles that no other candidate has, and packed bits.

    The intersection with any other set lacks own; sets for which that rules out every link
    are left out. own is counted by set, not by id: an id may have several texts.
    """
    alone = full.select("set_a", F.explode("values").alias("v")).groupBy("v").agg(F.min("set_a").alias("set_a"), F.max("set_a").alias("other")).where("set_a = other")
    own = alone.groupBy("set_a").agg(F.count("*").alias("own"))
    facts = classes.select("id", "set_a", F.col("n_shingles").alias("n"), "bits").join(full.select("id").distinct(), "id").join(own, "set_a", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"), "bits")
    return common.written(facts.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "facts")


def _possible(x: str, y: str, percent: int):
    """Whether two sets can be similar enough: a bound from what each has alone, and the bits' estimate."""
    both = lambda a, b: 100 * (F.col(f"{a}.n") - F.col(f"{a}.own")) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.own"))
    near = lambda n: estimate(f"{x}.bits", f"{y}.bits", n) >= least_estimate(percent, n)
    return both(x, y) & both(y, x) & near(HASHES // 4) & near(HASHES)


def _pairs(met: DataFrame, x: str, y: str, percent: int, also=None) -> DataFrame:
    """a, b: the smaller and larger id of each possible pair, once. also: a further condition, for those."""
    ids = F.col(f"{x}.id"), F.col(f"{y}.id")
    possible = _possible(x, y, percent) if also is None else _possible(x, y, percent) & also
    return met.where(possible).select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()


#: Pairs of one document that meet its set in one place.
AT_ONCE = 256


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union.

    The set of a document with many pairs goes to several places, AT_ONCE pairs in each, about.
    """
    many = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("cuts")).where("cuts > 1")
    many = common.beside(common.written(many, "many"))
    cuts = F.coalesce("cuts", F.lit(1))
    spread = full.join(many, "id", "left").select("id", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), "values")
    for end, other, name in (("a", "b", "va"), ("b", "a", "vb")):
        dealt = pairs.join(many.withColumnRenamed("id", end), end, "left").withColumn("cut", F.pmod(F.xxhash64(other), cuts).cast("int")).drop("cuts")
        pairs = dealt.join(spread.select(F.col("id").alias(end), "cut", F.col("values").alias(name)), [end, "cut"]).drop("cut")
    inter = F.size(F.array_intersect("va", "vb"))
    return pairs.where(100 * inter >= percent * (F.size("va") + F.size("vb") - inter)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id that links (a, b) reach from each id they name.

    Labels spread along links and are then replaced by their own labels (pointer jumping),
    so a path shortens by half in each round. Every round is one table in the shared folder.
    """
    both = common.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = common.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels", changed=F.count(F.lit(1)))
    while now.counts["changed"]:
        near = both.join(now.select(F.col("id").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        least = now.join(near, now.id == near.b).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("id").alias("at"), F.col("label").alias("further"))
        nxt = least.join(jump, least.label == jump.at).select("id", F.least("label", "further").alias("label"), "was")
        before, now = now, common.written(nxt, "labels", changed=F.count(F.when(F.col("was") != F.col("label"), 1)))
        common.drop(before)
    common.drop(both)
    return now.drop("was")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, label: the components labels (id, label) with those united that further links (a, b) connect.

    Components are linked by their labels, so all their members follow, whichever of them
    has the link. An id that labels lacks is its own component.
    """
    ends = links.select("a", "b").withColumn("n", F.monotonically_increasing_id())
    ends = ends.select("n", F.explode(F.array("a", "b")).alias("id")).join(labels, "id", "left").select("n", "id", F.coalesce("label", "id").alias("label"))
    ends = common.written(ends, "ends")
    between = ends.groupBy("n").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b")
    roots = components(between).select(F.col("id").alias("label"), F.col("label").alias("root"))
    all_ = labels.select("id", "label").union(ends.select("id", "label")).distinct()
    return common.written(all_.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")


#: Pairs that one task compares where stars leave many apart.
TOGETHER = 1 << 18


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    k: words in a shingle; percent: least Jaccard similarity. A text with fewer words than
    k is one shingle; one without words, or null, is linked with nothing. component_id is
    the smallest doc_id reachable over links; kept is doc_id = component_id. Rows that
    share a doc_id count as one document with several texts. Rows with a null doc_id are
    returned with a null component_id and kept, and link nothing. A very long text is one
    row of shingles in one task. Other columns are left alone; an empty table gives no rows.
    """
    all_ = common.written(sketches(docs, k), "sketches")
    known = all_.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set_a", "set_b"]
    least = F.min_by(F.struct("bands", "bits"), "doc_id")
    folded = common.written(known.groupBy(*key).agg(F.min("doc_id").alias("id"), least.alias("s")).select(*key, "id", "s.bands", "s.bits"), "classes")
    # A doc_id with several texts ties the classes of all of them.
    several = common.written(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several", n=F.count(F.lit(1)))
    links = []
    if several.counts["n"]:
        links.append(common.written(known.join(several, "doc_id").join(folded.select(*key, "id"), key).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct(), "ties"))
    exploded = folded.select("id", F.explode("bands").alias("band"))
    buckets = common.written(exploded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("band"), "buckets")
    members = common.written(exploded.join(common.beside(buckets), "band"), "members")  # only buckets with two ids or more
    ids = common.written(members.select("id").distinct(), "ids")
    text = docs.select(F.col("doc_id").alias("id"), "text").join(common.beside(ids), "id", "left_semi")
    full = common.written(sets(text, k), "sets")
    fact = F.struct("id", "n", "own", "bits")
    live = common.written(members.join(_hopeful(full, folded, percent), "id").select("band", fact.alias("y")), "live")
    # Two centres a bucket: the member with the smallest share of its own, and one by its hash, which other buckets choose as well.
    picked = F.array(F.min_by("y", F.struct(F.col("y.own") / F.col("y.n"), "y.id")), F.min_by("y", F.struct(F.xxhash64("y.id"), "y.id")))
    centres = live.groupBy("band").agg(picked.alias("cs"), F.count("*").alias("m")).where("m > 1").select("band", F.explode("cs").alias("c"))
    tested = common.written(_pairs(live.join(centres, "band").where("y.id <> c.id"), "c", "y", percent), "pairs")
    links.append(common.written(confirmed(tested, full, percent), "links"))
    labels = components(functools.reduce(DataFrame.unionByName, links))
    # What stars leave apart: the members outside their bucket's largest component, against the others' members.
    seen = live.withColumn("id", F.col("y.id")).join(labels, "id", "left").select("band", "y", F.coalesce("label", "id").alias("label"))
    parts = seen.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("m")).where("m > most")
    cuts = F.ceil((F.col("m") - F.col("most")) * F.col("m") / TOGETHER).cast("int").alias("cuts")
    main = common.written(main.select("band", "main", cuts), "main", n=F.count(F.lit(1)))
    if main.counts["n"]:
        every = folded.select("id", "bands")
        split = common.written(seen.join(common.beside(main), "band").withColumn("id", F.col("y.id")).join(every, "id").drop("id"), "split")
        odd = split.where("label <> main").select("band", F.col("y").alias("x"), F.col("label").alias("lx"), F.pmod(F.xxhash64("y.id"), F.col("cuts")).cast("int").alias("cut"), F.col("bands").alias("bx"))
        rest = split.select("band", "y", "bands", F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("inner"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        apart = odd.join(rest, ["band", "cut"]).where((F.col("lx") != F.col("ly")) & (F.col("inner") | (F.col("x.id") < F.col("y.id"))))
        # Two that share several bands are taken up in the first of them.
        first = F.filter(F.zip_with("bx", "bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())[0] == F.col("band")
        pairs = common.written(_pairs(apart, "x", "y", percent, first).join(tested, ["a", "b"], "left_anti"), "pairs", n=F.count(F.lit(1)))
        if pairs.counts["n"]:
            labels = joined(labels, common.written(confirmed(pairs, full, percent), "links"))
        common.drop(split, pairs)
    of = common.written(folded.join(labels, "id", "left").select(*key, F.coalesce("label", "id").alias("component")), "components")
    common.drop(folded, several, buckets, members, ids, full, live, tested, main, *links)
    empty = F.col("n_shingles") == 0
    out = all_.select("doc_id", *key).join(of, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(empty, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(common.beside(common.written(gone, "copies")), "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents, sets of four-word shingles."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4)
