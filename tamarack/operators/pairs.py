"""Every query with every chunk, in blocks of bounded size.

Blocks of queries and of chunks meet in cells by an equi-join. In a cell a matrix product
in single precision tells what may be among the nearest, with a margin above its rounding
errors; the distances of these alone are summed in doubles, one component after the other,
as the plan's own functions sum them. Queries of which single precision leaves too many, and
rows that aren't plain, go by a product in doubles. A cell returns what its chunks can add to
each query's result.

Components that are null or that the shorter vector lacks are left out of sums; a distance
without any component is null. NaN comes after all numbers, null after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Distances in memory at once, about.
DISTANCES = 1 << 22
#: In single precision: chunks and queries of a tile, which stays in a core's cache, and chunks of which the least distance is kept.
TILE, ASKED, PIECE = 1024, 512, 128


class Rows:
    """Vectors as rows of doubles; where nothing is there, 0."""

    def __init__(self, x: np.ndarray, there: np.ndarray):
        self.x, self.there = x, there
        with np.errstate(all="ignore"):
            self.length = np.sqrt(_sums(x * x))

    @classmethod
    def read(cls, column: pa.ChunkedArray, width: int) -> Rows:
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # without chunks
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        there = np.arange(width) < pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)[:, None]
        flat = column.flatten()
        x = np.zeros(there.shape)
        x[there] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
        there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        return cls(x, there)

    def __len__(self) -> int:
        return len(self.x)

    def take(self, at) -> Rows:
        return Rows(self.x[at], self.there[at])

    def plain(self) -> np.ndarray:
        """Which rows are whole, finite and of a length that matrix products handle well."""
        out = self.there.all(1) & np.isfinite(self.x).all(1) & (self.length > 1e-100) & (self.length < 1e100)
        return out & (self.length <= 1000 * np.median(self.length[out])) if out.any() else out


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, one number after the other."""
    return np.cumsum(x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _width(*columns: pa.ChunkedArray) -> int:
    return max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns)


def exact(a: Rows, b: Rows, row: np.ndarray, column: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of pairs of rows of a (queries) and b (chunks), and which of them are null."""
    out, null = np.empty(len(row)), np.empty(len(row), bool)
    step = max(1, (1 << 21) // max(1, a.x.shape[1]))
    with np.errstate(all="ignore"):
        for i in range(0, len(row), step):
            r, c = row[i : i + step], column[i : i + step]
            x, y, both = a.x[r], b.x[c], a.there[r] & b.there[c]
            terms = (y - x) * (y - x) if metric == "l2sq" else y * x
            total = _sums(np.where(both, terms, 0.0))
            null[i : i + step] = ~both.any(1)
            if metric == "ip":
                total = -total
            elif metric == "cosine":
                total = 1 - total / (b.length[c] * a.length[r])
            out[i : i + step] = np.where(null[i : i + step], np.nan, total)
    return out, null


class Near:
    """Distances of blocks of queries to all chunks, less what is the same for all chunks of a query."""

    def __init__(self, a: Rows, b: Rows, metric: str):
        self.a, self.b, self.metric = a, b, metric
        self.good, self.fine = a.plain(), b.plain()
        x, y = a.x[self.good], b.x[self.fine]
        self.left, self.offset = x, 0.0
        if metric == "cosine":
            self.left, y = x / a.length[self.good, None], y / b.length[self.fine, None]
        elif metric == "l2sq":
            self.offset, y = (y * y).sum(1), 2 * y
        self.right = np.ascontiguousarray(-y.T)
        far, of = b.length[self.fine].max(initial=0.0), a.length[self.good]
        self.longest = max(far, of.max(initial=0.0))
        size = {"l2sq": (of + far) ** 2, "ip": of * far, "cosine": np.full(len(of), 4.0)}[metric]
        #: For each query, twice what two computations of a distance can differ by.
        self.margin = np.zeros(len(a))
        self.margin[self.good] = 4 * (a.x.shape[1] + 8) * np.finfo(float).eps * size
        self.at = np.cumsum(self.good) - 1

    def block(self, rows: np.ndarray) -> np.ndarray:
        """Those of some queries; NaN and null are infinite."""
        good, fine = self.good[rows], self.fine
        p = self.left[self.at[rows][good]] @ self.right
        p += self.offset
        if good.all() and fine.all():
            return p
        d = np.empty((len(good), len(self.b)))
        d[np.ix_(good, fine)] = p
        odd = ~(good[:, None] & fine)
        row, column = np.nonzero(odd)
        values, _ = exact(self.a, self.b, rows[row], column, self.metric)
        if self.metric == "l2sq":
            values = values - np.where(good, self.a.length[rows] ** 2, 0.0)[row]
        elif self.metric == "cosine":
            values = values - 1
        d[odd] = np.where(np.isnan(values), np.inf, values)
        return d


class Sieve:
    """What may be near, by products in single precision: good queries with fine chunks alone.

    Tiles of chunks are cut into pieces, which end where a group ends. A first pass keeps the
    least distance of each piece; n pieces, or groups, bound what may be among the nearest. A
    second pass looks into the tiles where something may be below that.
    """

    def __init__(self, near: Near, n: int, group: np.ndarray | None):
        self.n, self.chunks, self.queries = n, np.nonzero(near.fine)[0], np.nonzero(near.good)[0]
        self.others = len(near.b) - len(self.chunks)
        # numbers up to 1; a power of two rounds nothing
        scale = 2.0 ** -np.ceil(np.log2(near.longest)) if near.metric != "cosine" and near.longest else 1.0
        self.left = np.ones((len(self.queries), near.right.shape[0] + 1), np.float32)
        self.left[:, :-1] = near.left * scale
        self.right = np.empty((len(self.chunks), self.left.shape[1]), np.float32)
        self.right[:, :-1], self.right[:, -1] = (near.right * scale).T, near.offset * scale**2
        self.margin = near.margin[self.queries] * (np.finfo(np.float32).eps / np.finfo(float).eps) * scale**2 + 1e-30
        at = np.arange(len(self.chunks))
        if group is None:
            new = at % TILE % min(max(len(at) // (8 * n), 1), PIECE) == 0
        else:
            group = group[self.chunks]
            starts = np.r_[True, group[1:] != group[:-1]] if len(at) else np.zeros(0, bool)
            new = starts | (at % TILE == 0)
            self.of = np.cumsum(starts)[new] - 1  # each piece's group
            self.groups = np.nonzero(starts[new])[0]
        self.grouped, self.pieces = group is not None, np.nonzero(new)[0]
        self.sizes = np.diff(np.r_[self.pieces, len(at)])
        ends = np.r_[at[::TILE], len(at)]
        self.tiles = [(s, e, *self.pieces.searchsorted([s, e])) for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def blocks(self) -> Iterator[np.ndarray]:
        """Places in left; of their distances to pieces, and to chunks that aren't fine, so many fit into memory."""
        return _blocks(np.arange(len(self.queries)), max(len(self.pieces), self.others), ASKED)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, chunks, queries of which there are too many)."""
        left, margin, n = self.left[rows], self.margin[rows, None], self.n
        low = np.empty((len(rows), len(self.pieces)), np.float32)
        for s, e, i, j in self.tiles:
            np.minimum.reduceat(left @ self.right[s:e].T, self.pieces[i:j] - s, 1, out=low[:, i:j])
        least = np.minimum.reduceat(low, self.groups, 1) if self.grouped and low.size else low
        limit = np.full((len(rows), 1), np.inf)
        if least.shape[1] > n:
            limit = np.partition(least, n - 1, 1)[:, n - 1 : n] + margin
        if self.grouped:
            limit = np.where(least <= limit, least + margin, -np.inf)[:, self.of]
        limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        wanted, count, out = low <= limit, np.zeros(len(rows), np.int64), []
        for s, e, i, j in self.tiles:
            at = np.nonzero(wanted[:, i:j].any(1) & (count <= self.many))[0]
            if len(at):
                bound = np.repeat(limit[at, i:j], self.sizes[i:j], 1) if self.grouped else limit[at]
                row, column = _set(left[at] @ self.right[s:e].T <= bound)
                count[at] += np.bincount(row, minlength=len(at))
                out.append((at[row], column + s))
        row, column = (np.concatenate(x) for x in zip(*out, strict=True)) if out else np.zeros((2, 0), np.int64)
        few = count[row] <= self.many
        return self.queries[rows[row[few]]], self.chunks[column[few]], self.queries[rows[count > self.many]]

    @property
    def many(self) -> int:
        """Chunks of a query from which on doubles tell more."""
        return 4 * self.n + 64


def _set(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of what is nearly all false, by words of eight."""
    if bits.shape[1] % 8:
        return np.nonzero(bits)
    words = np.flatnonzero(bits.view(np.uint64).ravel())
    at, byte = np.nonzero(bits.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + byte, bits.shape[1])


def firsts(rows: Rows, limit: int, *groups: np.ndarray) -> np.ndarray:
    """Places of rows, but of equal vectors in equal groups only the first so many."""
    parts = [rows.x, *(g.astype(float)[:, None] for g in groups)] + ([] if rows.there.all() else [rows.there.astype(float)])
    every = np.ascontiguousarray(np.concatenate(parts, 1))
    if not every.size:
        return np.arange(min(limit, len(rows)))
    odd = np.random.default_rng(5).integers(0, 2**63, every.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = every.view(np.uint64)
    _, which, counts = np.unique(((bits ^ (bits >> np.uint64(31))) * odd).sum(1, dtype=np.uint64), return_inverse=True, return_counts=True)
    many = np.nonzero(counts[which] > limit)[0]
    if not len(many):
        return np.arange(len(rows))
    _, same = np.unique(every[many].view(np.dtype((np.void, every.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    keep = np.ones(len(rows), bool)
    keep[many[order[_nth(same[order]) >= limit]]] = False
    return np.nonzero(keep)[0]


def _nth(runs: np.ndarray) -> np.ndarray:
    """Each place's number within its run of equal values, from 0."""
    new = np.r_[True, runs[1:] != runs[:-1]] if len(runs) else np.zeros(0, bool)
    return np.arange(len(runs)) - np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))


def _in_order(chunks: pa.Table, key: str) -> pa.Table:
    return chunks.take(pc.sort_indices(chunks, sort_keys=[(key, "ascending")], null_placement="at_end"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    filled = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    return pc.fill_null(pc.rank(filled, "ascending", tiebreaker="dense"), 0).to_numpy().astype(np.int64)


def _places(d: np.ndarray, margin: np.ndarray, n: int, starts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among a query's n nearest, or be the nearest of one of its n nearest groups."""
    low = d if starts is None else np.minimum.reduceat(d, starts, 1)
    last = np.partition(low, n - 1, 1)[:, n - 1] + margin if low.shape[1] > n else np.full(len(d), np.inf)
    if starts is None:
        return np.nonzero(d <= last[:, None])
    limit = np.where(low <= last[:, None], low + margin[:, None], -np.inf)
    return np.nonzero(d <= np.repeat(limit, np.diff(np.r_[starts, d.shape[1]]), 1))


def _blocks(rows: np.ndarray, columns: int, most: int | None = None) -> Iterator[np.ndarray]:
    step = max(1, min(DISTANCES // max(1, columns), most or DISTANCES))
    for i in range(0, len(rows), step):
        yield rows[i : i + step]


def _candidates(near: Near, n: int, group: np.ndarray | None, starts: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be among a query's n nearest, or be the nearest of one of its n nearest groups; all of a query's at once."""
    sieve, rest = Sieve(near, n, group), [np.nonzero(~near.good)[0]]
    odd = np.nonzero(~near.fine)[0]
    for block in sieve.blocks():
        row, column, hard = sieve.places(block)
        rest.append(hard)
        asked = np.setdiff1d(sieve.queries[block], hard, assume_unique=True)
        yield np.r_[row, np.repeat(asked, len(odd))], np.r_[column, np.tile(odd, len(asked))]
    for rows in _blocks(np.concatenate(rest), len(near.b)):
        row, column = _places(near.block(rows), near.margin[rows], n, starts)
        yield rows[row], column


def best(asked: pa.Table, chunks: pa.Table, n: int, metric: str, key: str, by: str | None) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """(chunks, queries' places, chunks' places, distances): the n nearest of each query by distance, then key; with by, the nearest of each of n groups."""
    none = np.zeros(0, np.int64)
    if not asked.num_rows or not chunks.num_rows:  # a cell of one side
        return chunks, none, none, pa.array([], pa.float64())
    chunks = _in_order(chunks, key)
    width = _width(asked["query_embedding"], chunks["embedding"])
    a, b = Rows.read(asked["query_embedding"], width), Rows.read(chunks["embedding"], width)
    group = _codes(chunks[by]) if by else np.zeros(len(b), np.int64)
    at = firsts(b, 1 if by else n, group)
    if by:
        at = at[np.argsort(group[at], kind="stable")]
    b, group = b.take(at), group[at]
    starts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0] if by else None
    out = [(none, none, np.zeros(0), np.zeros(0, bool))]
    for row, column in _candidates(Near(a, b, metric), n, group if by else None, starts):
        value, null = exact(a, b, row, column, metric)
        order = np.lexsort((at[column], value, null, row))
        if by:
            _, first = np.unique(row[order] * len(b) + starts.searchsorted(column[order], "right"), return_index=True)
            order = order[np.sort(first)]
        order = order[_nth(row[order]) < n]
        out.append((row[order], at[column[order]], value[order], null[order]))
    row, column, value, null = (np.concatenate(x) for x in zip(*out, strict=True))
    return chunks, row, column, pa.array(value, mask=null)


def swept(asked: pa.Table, chunks: pa.Table, weights: list[tuple[float, float]], k: int, key: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(chunks, numbers of weights, queries' places, chunks' places, distances): all that may be among a query's k best files for a pair of weights.

    chunks: key, embedding, lev, path_distance. Scores that differ by less than their nine
    digits tell are left to the caller.
    """
    none = np.zeros(0, np.int64)
    if not asked.num_rows or not chunks.num_rows:  # a cell of one side
        return chunks, none, none, none, pa.array([], pa.float64())
    chunks = _in_order(chunks, key)
    width = _width(asked["query_embedding"], chunks["embedding"])
    a, b = Rows.read(asked["query_embedding"], width), Rows.read(chunks["embedding"], width)
    lev, far = (chunks[c].to_numpy().astype(float) for c in ("lev", "path_distance"))
    at = firsts(b, k, lev, far)
    b, lev, far = b.take(at), lev[at], far[at]
    near, out = Near(a, b, "cosine"), []
    alike = Rows(np.zeros((len(b), 0)), np.zeros((len(b), 0), bool))
    few = np.union1d(firsts(alike, k, lev, far), np.nonzero(~near.fine)[0])  # where cosines don't count
    every = np.arange(len(b))
    with np.errstate(all="ignore"):
        for rows in _blocks(np.arange(len(a)), len(b)):
            cos = -near.block(rows)  # NaN and null: -inf
            for w, (alpha, beta) in enumerate(weights):
                use = few if alpha == 0 else every
                decay = np.where(far[use] == 0, 1.0, beta ** far[use])
                score = cos[:, use] * (decay * alpha) if alpha else np.where(np.isfinite(cos[:, use]), 0.0, -np.inf)
                score += decay * (1 - alpha) * lev[use]
                score *= -1
                lost = ~np.isfinite(score)
                score[lost] = np.inf
                last = np.partition(score, k - 1, 1)[:, k - 1] if score.shape[1] > k else np.full(len(score), np.finfo(float).max)
                chosen = score <= np.minimum(last + near.margin[rows] + 4e-9, np.finfo(float).max)[:, None]
                if lost.any():  # NaN is first, null last, each by key
                    null = lost & (a.there[rows].astype(float) @ b.there[use].T.astype(float) == 0)
                    for these in (null, lost & ~null):
                        chosen |= these & (np.cumsum(these, 1) <= k)
                row, column = np.nonzero(chosen)
                out.append((np.full(len(row), w), rows[row], use[column]))
    number, row, column = (np.concatenate(x) for x in zip(*out, strict=True))
    value, null = exact(a, b, row, column, "cosine")
    return chunks, number, row, at[column], pa.array(value, mask=null)


def cells(chunks: DataFrame, queries: DataFrame, key: str, values: int):
    """Chunks and queries (query_id, query_embedding) dealt to cells of so many numbers of vectors, about, for applyInArrow."""
    ship(chunks.sparkSession)
    numbers = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(1)).cast("long")), F.lit(0))
    n, held = chunks.agg(F.count("*"), numbers("embedding")).first()
    m, asked = queries.agg(F.count("*"), numbers("query_embedding")).first()
    blocks = max(1, -(-held // values))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-4 * asked // values), min(-(-m // 64), -(-3 * cores // blocks)))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    keys = ["block_", "part_"]
    left = queries.select(own("query_id", parts).alias("part_"), up_to(blocks).alias("block_"), *queries.columns)
    right = chunks.select(own(key, blocks).alias("block_"), up_to(parts).alias("part_"), *chunks.columns)
    left, right = (df.repartition(min(blocks * parts, 2000), *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))
