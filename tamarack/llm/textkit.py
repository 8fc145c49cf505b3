"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Texts are laid end to end as bytes and all work is array work: no Python object is made
for a word. Equal words get equal hashes in every process; with 64 bits, unequal words
meet once in about 10^19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
#: The words' separators: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
CHUNK = 1 << 20

_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and those of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 4096), b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many bytes together, one text at least."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of some texts.

    buffer: all bytes, a separator after each text; start, end: of each word there;
    hash: of each word; text: index of its text; first: for each text the number of its
    first word, with one more entry for the end.
    """

    def __init__(self, texts: list[bytes], separator: bytes = b" ", folded: bool = True, solid=None):
        """solid: tells, from the buffer, which bytes belong to words; by default all but SPACE."""
        self.buffer = buffer = np.frombuffer(separator.join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        edge = np.flatnonzero(np.diff((solid or (lambda x: ~SPACE[x]))(buffer), prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(buffer) + 1))
        self.first[-1] = len(self.start)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self.spans(self.start, self.end, folded)

    def spans(self, start: np.ndarray, end: np.ndarray, folded: bool = True) -> np.ndarray:
        """Hashes of byte ranges."""
        power, inverse = _power(len(self.buffer))
        total = np.zeros(len(self.buffer) + 1, U)
        np.cumsum((_FOLDED if folded else _BYTES)[self.buffer] * power, out=total[1:])
        return mix((total[end] - total[start]) * inverse[np.minimum(start, len(inverse) - 1)] + (end - start).astype(U))


_PLACES = _RNG.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k words in a row, and for each text the number of its first shingle.

    whole: a text with fewer words, but some, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    if whole:
        count = np.where((n > 0) & (n < k), 1, count)
    at = np.concatenate([[0], np.cumsum(count)])
    where = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = np.zeros(at[-1], U)
    padded = np.append(hashes, np.zeros(k, U))
    for j in range(k):
        out += np.where(length > j, padded[where + j] * _PLACES[j], U(0))
    return mix(out + length.astype(U)), at


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and where each text's begin."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.concatenate([[0], np.cumsum(new)])[first]
    return values[new], at
