"""Embedders: columns, hashed tokens, or any function on batches of texts."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


class Embedder(Protocol):
    dimensions: int

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """df with a vector column for a text column."""


class HashingEmbedder:
    """Each token adds 1 to the bucket its MD5 names; the vector is scaled to length 1.

    Lower-casing stays in the plan; tokens are counted in Arrow batches, where a worker
    remembers the buckets of KNOWN tokens. Nothing is shuffled. A text that is null or
    without tokens is the zero vector.
    """

    KNOWN = 200_000

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def add(self, df: DataFrame, text: str = "document", out: str = "embedding") -> DataFrame:
        ship(df.sparkSession)
        d, most = self.dimensions, self.KNOWN

        @F.arrow_udf("array<double>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets: dict[str, int] = {}
            words = re.compile("[a-z0-9_]+")
            for texts in batches:
                counts = np.zeros((len(texts), d))
                for row, t in enumerate(texts):
                    found = words.findall(t.as_py() or "")
                    if len(buckets) > most:
                        buckets.clear()
                    for w in found:
                        if w not in buckets:
                            buckets[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % d
                    counts[row] = np.bincount([buckets[w] for w in found], minlength=d) if found else 0.0
                length = np.sqrt((counts * counts).sum(1))  # whole numbers: exact in any order
                counts /= np.where(length > 0, length, 1.0)[:, None]
                yield pa.ListArray.from_arrays(np.arange(0, counts.size + 1, d, dtype=np.int32), pa.array(counts.ravel()))

        return df.withColumn(out, embed(F.lower(F.col(text))))


class FunctionEmbedder:
    """open() -> a function on a list of texts, called once a partition, as for a model or a client."""

    def __init__(self, open_: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int):
        self.open, self.dimensions = open_, dimensions

    def add(self, df: DataFrame, text: str = "document", out: str = "embedding") -> DataFrame:
        ship(df.sparkSession)
        open_ = self.open

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            call = open_()
            for texts in batches:
                yield pd.Series(call(texts.tolist()), index=texts.index)

        return df.withColumn(out, embed(F.col(text)))


class EmbeddingError(RuntimeError):
    """The service gave no vector."""


class HttpEmbedder(FunctionEmbedder):
    """Posts {"model", "prompt"} and reads {"embedding"}; empty texts and refusals aren't tried again, time-outs are."""

    def __init__(self, url: str, model: str, dimensions: int, retries: int = 2, delay: float = 1.0, timeout: float = 120.0):
        def call(text: str) -> list[float]:
            if not text.strip():
                raise EmbeddingError("an empty text has no embedding")
            body = json.dumps({"model": model, "prompt": text}).encode()
            for attempt in range(retries + 1):
                try:
                    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        found = json.load(answer).get("embedding")
                    if not found:
                        raise EmbeddingError("the answer holds no embedding")
                    return [float(x) for x in found]
                except (TimeoutError, urllib.error.URLError) as e:
                    if isinstance(e, urllib.error.HTTPError) or attempt == retries:
                        raise EmbeddingError(str(e)) from e
                    time.sleep(delay)
            raise EmbeddingError("not reached")

        super().__init__(lambda: lambda texts: [call(t) for t in texts], dimensions)
