"""License scans with DataFrame functions alone.

Texts are cut into overlapping windows of words; a window's shingles give MinHash values,
banded; windows that share a band with a license template retrieve it, and exact shingle
containment verifies the match.

For a template of n words, windows have about 5/4 n words and begin every (w - n + 1)
words, so each occurrence lies whole in some window. A window with ``CONTAINED`` of the
template's shingles has Jaccard similarity 0.65 with it at least; with 32 bands of two
values it is retrieved with probability 1 - (1 - 0.65^2)^32, over 0.9999999.

Every template contains an anchor word in more than a tenth of its shingles (checked when
the module loads), so a window without one can't match; only windows with anchors are
hashed. The templates are a constant of this module, so is the size of what is broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
BANDS, ROWS = 32, 2
CONTAINED = 0.9
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License version 3"],
    "GPL-2.0": ["licensed under the GNU General Public License version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License"],
    "BSD": ["Licensed under the BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "CC0-1.0": ["dedicated to the public domain under CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved"],
}
ANCHORS = ("license", "licensed", "permission", "copyright", "rights", "redistribution", "permitted", "released", "domain", "cc", "cc0", "hereby", "granted", "software", "binary", "mozilla", "gnu", "compliance")


def _split(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(words: list[str]) -> list[str]:
    k = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


for _texts in TEMPLATES.values():
    for _t in _texts:
        _g = _grams(_split(_t))
        if sum(not set(x.split()) & set(ANCHORS) for x in _g) >= CONTAINED * len(_g):
            raise ValueError(f"no anchor in a tenth of: {_t}")


def _bands(shingles: Column) -> Column:
    least = lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *(least(b * ROWS + r) for r in range(ROWS))))


def _shingles(words: Column, k: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, k))))


def _windows(n: int, anchors: Column) -> Column:
    """The windows of ``words`` for templates of n words: those that hold an anchor."""
    width = math.ceil(1.25 * n)
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)), F.lit(width - n + 1))
    every = F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.slice("words", i + 1, width).alias("w")))
    return F.filter(every, lambda z: F.arrays_overlap(z["w"], anchors) & (F.size(z["w"]) >= min(n, SHINGLE)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, first_word, n_windows, containment: each license that a document of docs (doc_id, text) holds.

    first_word: number of the first word of the first window that matches; n_windows: how
    many match; containment: the largest share of a template's shingles in one. Words are
    runs of ASCII letters and digits, in lower case. Null and empty texts hold none; rows
    that share doc_id and text count once, several texts of a doc_id each for itself. Other
    columns are left alone.
    """
    spark = docs.sparkSession
    anchors = F.array(*map(F.lit, ANCHORS))
    near = docs.where(F.col("text").rlike(r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"))
    split = near.select("doc_id", F.xxhash64("text").alias("rid"), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    rows = [(name, len(w), w, _grams(w)) for name, texts in TEMPLATES.items() for w in map(_split, texts)]
    constant = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for name, n, _, g in rows))
    templates = spark.range(1).select(F.explode(constant).alias("t")).select("t.*")
    keyed = templates.select("license", "n", "grams", F.explode(_bands(F.col("grams"))).alias("band"))
    every = [_windows(n, anchors) for n in sorted({r[1] for r in rows})]
    cut = split.select("doc_id", "rid", F.explode(F.concat(*every)).alias("z"))
    windows = cut.select("doc_id", "rid", "z.n", "z.at", _shingles(F.col("z.w"), F.least("z.n", F.lit(SHINGLE))).alias("own"))
    met = windows.select("*", F.explode(_bands(F.col("own"))).alias("band")).join(F.broadcast(keyed), ["n", "band"])
    share = F.size(F.array_intersect("own", "grams")) / F.size("grams")
    good = met.withColumn("share", share).where(F.col("share") >= CONTAINED).select("doc_id", "rid", "license", "at", "share")
    window = good.groupBy("doc_id", "rid", "license", "at").agg(F.max("share").alias("share"))
    return window.groupBy("doc_id", "rid", "license").agg(F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"), F.max("share").alias("containment")).drop("rid")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents."""
    return scan(common.table(spark, sf_dir, "documents"))
