"""Secret scans with DataFrame functions alone.

Three base patterns find assigned secrets, access keys and long hexadecimal strings. Other
long runs of key characters are judged by two Markov models over characters, one of random
strings and one of ordinary identifiers: a run is a secret if its log-likelihood ratio,
summed over its pairs of neighbouring characters, is high enough. Both models are counted
from labelled samples when this module is first used; scoring is a look-up in a constant
array, inside the plan.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of 32 or more; shorter runs can't contain a match.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ACCESS = r"AKIA[A-Z0-9]{12,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Least ratio, in nats: in all, and for each pair of characters.
LEAST, LEAST_EACH = 8.0, 0.25

_WORDS = """the of and that with from this have which their would there been more when other time about could than first
into only state some these then such years people after work world made life still should being great through where much
before because good each those long between system without during house school while place small number against general
public water government however another since development important history national information different program company
children student experience question business several country including together research community possible example
get set is has make create update delete remove insert find load save read write open close parse format encode decode
handle process validate convert render build start stop init reset clear flush push pop list map array string integer
value key name index count size length offset buffer cache queue stack tree node edge graph path file directory folder
user account session request response client server service manager controller factory builder provider adapter handler
listener observer iterator config option default property attribute element component module package library version
license http https www com org net html css json xml yaml src main test docs assets images static public private
und der die das ist nicht ein eine mit auf fuer von zu den dem sich auch werden wurde haben sein keit lich schaft ungen
verantwortung gesellschaft entwicklung moeglichkeit zusammenarbeit wissenschaft geschwindigkeit
que les des une dans pour avec sur pas elle sont cette entre plus comme mais aux tion ment eaux oire ette
developpement gouvernement etablissement naturellement communication
los las por con para como mas pero sus este cuando muy sin sobre tambien hasta cion mente idad aron iendo
universidad informacion desarrollo organizacion conocimiento""".split()


@functools.cache
def samples() -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers): the labelled training samples."""
    rng = random.Random(17)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = [low + up + digit, low + up + digit + "+/", low + up + digit + "_-", low + digit, up + digit, digit + "abcdef"]
    keys = ["".join(rng.choice(sets[i % 6]) for _ in range(rng.randint(20, 64))) for i in range(3000)]
    plain = []
    for i in range(6000):
        parts = [rng.choice(_WORDS) for _ in range(rng.randint(2, 6))]
        style = i % 7
        if style == 0:
            plain.append("_".join(parts))
        elif style == 1:
            plain.append("".join(p.capitalize() for p in parts))
        elif style == 2:
            plain.append("-".join(parts) + (f"-{rng.randint(1, 99)}" if i % 3 else ""))
        elif style == 3:
            plain.append("/".join(parts))
        elif style == 4:
            plain.append("_".join(parts).upper())
        else:
            plain.append("".join(parts))
    plain += ["=" * 40, "-" * 60, "_" * 40, "+-" * 20, "2024-01-02_2024-02-03", "1000000000000000000000", "0123456789012345678901"] * 20
    return keys, plain


_SYMBOLS = 56
#: Of each ASCII code: letters one by one, digits together, then the other characters.
_SYMBOL = [0] * 128
for _i in range(26):
    _SYMBOL[97 + _i], _SYMBOL[65 + _i] = _i, 26 + _i
for _i in range(10):
    _SYMBOL[48 + _i] = 52
for _c in "+/=":
    _SYMBOL[ord(_c)] = 53
_SYMBOL[ord("_")], _SYMBOL[ord("-")] = 54, 55


@functools.cache
def ratios() -> list[float]:
    """log P(next | this) under the random model less that under the ordinary one; at this * _SYMBOLS + next."""
    logs = []
    for texts in samples():
        counts = [[0.5] * _SYMBOLS for _ in range(_SYMBOLS)]
        for t in texts:
            s = [_SYMBOL[ord(c)] for c in t]
            for a, b in zip(s, s[1:], strict=False):
                counts[a][b] += 1
        overall = [sum(row[b] for row in counts) for b in range(_SYMBOLS)]
        total = sum(overall)
        # Each row is drawn towards the characters' overall shares, so that a pair never met isn't decisive.
        smooth = [[(row[b] + 30 * overall[b] / total) / (sum(row) + 30) for b in range(_SYMBOLS)] for row in counts]
        logs.append([[math.log(x) for x in row] for row in smooth])
    return [round(logs[0][a][b] - logs[1][a][b], 6) for a in range(_SYMBOLS) for b in range(_SYMBOLS)]


def score(run: Column) -> Column:
    """The log-likelihood ratio of a run of key characters."""
    table = F.array(*(F.lit(x) for x in ratios()))
    symbol = F.array(*(F.lit(x) for x in _SYMBOL))
    codes = F.transform(F.split(run, ""), lambda c: F.get(symbol, F.ascii(c)))
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * _SYMBOLS + s))).alias("sum"))
    return F.aggregate(codes, zero, step)["sum"]


_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """start, kind, end (code points, end exclusive) and a group's text of each match, in order.

    Matches and the gaps between them are cut out side by side. Each match's place is the
    sum of what is before it: sums are taken in runs of RUN_SUMS, then over runs, so the
    work on a text with n matches grows with n * sqrt(n) at most, on numbers alone.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group"),
    )

    def placed(z: Column) -> Column:
        n = F.size(z) - 1  # the last gap has no match
        total = lambda a, b: F.aggregate(F.slice(z, a + 1, b - a), F.lit(0), lambda s, x: s + x["gap"] + x["match"])  # noqa: E731  of the parts from a to before b
        runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN_SUMS).cast("int")), lambda r: total(r * RUN_SUMS, F.least((r + 1) * RUN_SUMS, n)))

        def one(sums: Column) -> Column:
            def place(i: Column) -> Column:
                r = F.floor(i / RUN_SUMS).cast("int")
                start = F.aggregate(F.slice(sums, F.lit(1), r), F.lit(0), lambda s, x: s + x) + total(r * RUN_SUMS, i) + F.get(z, i)["gap"]
                return _named(start, lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.get(z, i)["match"]).alias("end"), F.get(z, i)["group"].alias("text")))

            return F.transform(F.sequence(F.lit(0), n - 1), place)

        return _named(runs, one)

    return F.when(text.rlike(pattern), _named(parts, placed)).otherwise(F.array().cast(_SPANS))


#: Matches whose lengths are summed together.
RUN_SUMS = 64


def _named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs (doc_id, text).

    spans: ``kind:start:end`` of all matches by start, then kind, comma-joined; those of
    kind ``random`` are the model's, where no base match overlaps. base_sha256: the
    lower-case digest of the same string without the model's. A null text is empty; a text
    without matches has empty strings. Repeated rows and null ids are returned as they come;
    other columns are left alone.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        "doc_id",
        F.filter(spans(text, ASSIGN, 0, 2), lambda z: F.length(z["text"]) >= 8).alias("a"),
        spans(text, ACCESS, 1).alias("k"),
        spans(text, HEX, 2).alias("h"),
        spans(text, RUN, 3).alias("r"),
    )
    base = found.select("doc_id", *(F.size(c).cast("long").alias(f"n_{n}") for c, n in zip("akh", KINDS, strict=False)), F.concat("a", "k", "h").alias("base"), "r")
    # A run's score is needed first; few runs are secrets, so few are compared with the base's matches.
    high = lambda z: _named(score(z["text"]), lambda s: (s >= LEAST) & (s >= LEAST_EACH * (F.length(z["text"]) - 1)))
    apart = lambda z: ~F.exists("base", lambda b: (b["start"] < z["end"]) & (z["start"] < b["end"]))
    more = base.withColumn("r", F.when(F.size("r") > 0, F.filter("r", lambda z: high(z) & apart(z))).otherwise(F.col("r")))
    names = F.array(*map(F.lit, KINDS))

    def said(column: Column) -> Column:
        plain = F.transform(column, lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind"), z["end"].alias("end")))
        return F.array_join(F.transform(F.sort_array(plain), lambda z: F.concat_ws(":", F.get(names, z["kind"]), z["start"], z["end"])), ",")

    return more.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "r")).alias("spans"), F.size("r").cast("long").alias("n_random"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents."""
    return scan(common.table(spark, sf_dir, "documents"))
