"""Runs of periodic words, found on a harmonic grid with suffix arrays, reversed arrays and range minima.

A stretch of at least 2p words with period p covers two neighbouring points jp and (j+1)p of the grid of p. So for each p
and j the words at the two points are compared, and where they are equal the longest common extensions forward and
backward give the whole repetition: it is a run if the extensions reach p words together. The grid of a document of n
words has about n ln n points. An extension is a range minimum over the common prefixes of neighbours in a suffix array;
backward it is the same over the reversed words. Of the periods that give one stretch the smallest is its period.

Documents are independent, so nothing is shuffled. A task joins documents into blocks of some BLOCK words, parted by
marks that equal nothing, so that the arrays of short documents are built together; a longer document is a block of its
own and takes about 300 bytes a word. The grid is walked in slices of GRID points.

Defined results: null text has no words; repeated rows each get a row; of runs of equal length the first start counts,
then the smallest period; a null id keeps its words as they are in plant(); extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Least length of a run, in words.
LEAST = 12
#: Words of the documents that share a suffix array.
BLOCK = 1 << 16
#: Points of the grid that are compared at once.
GRID = 1 << 22

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the suffixes, and the ranks of their first 1, 2, 4, ... values on the way (equal ranks: equal values).

    Prefix doubling: only suffixes that aren't told apart yet are sorted again.
    """
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    rank = np.cumsum(np.bincount(rank))[rank] - 1  # the last place of its group, so that a group may be split in place
    levels, step = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        left = np.flatnonzero(size[rank] > 1)
        if not len(left):
            return rank, levels
        after = np.full(len(left), -1, np.int64)
        inside = left + step < n
        after[inside] = rank[left[inside] + step]
        own = rank[left]
        order = np.lexsort((after, own))
        own, after, left = own[order], after[order], left[order]
        group = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        first = np.repeat(group, np.diff(np.r_[group, len(own)]))  # where the old group begins
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        last = np.repeat(np.r_[cut[1:], len(own)] - 1, np.diff(np.r_[cut, len(own)]))
        rank = rank.copy()
        rank[left] = own - (size[own] - 1) + last - first
        levels.append(rank.astype(np.int32))
        step *= 2


class Extensions:
    """Longest common extensions of pairs of places, by range minima over the suffix array's common prefixes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.rank, levels = suffix_array(values)
        at = np.empty(n, np.int64)
        at[self.rank] = np.arange(n)
        a, b = at[:-1].copy(), at[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.minima, width = [common], 1
        while 2 * width <= len(common):
            row = self.minima[-1]
            self.minima.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values that follow alike from a and from b, those places included; a and b differ."""
        out = np.empty(len(a), np.int64)
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            row = self.minima[level]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(level))])
        return out


class Grid:
    """Pairs (k - p, k) of all periods p that divide k, in order of k: those of n words are the first ones."""

    def __init__(self):
        self.near = self.far = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    @staticmethod
    def slice(first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of first <= k < end, in order of k."""
        fars, nears = [], []
        root = int(end**0.5) + 1
        for p in range(1, root):  # a divisor below the root, and its partner
            k = np.arange(-(-max(first, p) // p) * p, end, p)
            fars.append(k)
            nears.append(k - p)
            k = k[k // p >= root]
            fars.append(k)
            nears.append(k - k // p)
        far, near = np.concatenate(fars or [[]]).astype(np.int64), np.concatenate(nears or [[]]).astype(np.int64)
        order = np.argsort(far, kind="stable")
        return near[order], far[order]

    def pairs(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs within n words, at most about GRID at a time; those of short documents are kept."""
        if n >= len(self.ends) and n <= BLOCK:
            near, far = self.slice(1, top := min(BLOCK, 2 * n))
            self.near, self.far = near.astype(np.int32), far.astype(np.int32)
            self.ends = np.searchsorted(far, np.arange(top + 1))
        if n <= BLOCK:
            if n > 1:
                yield self.near[: self.ends[n]], self.far[: self.ends[n]]
            return
        wide = max(1, GRID // (n.bit_length() + 1))
        for first in range(1, n, wide):
            yield self.slice(first, min(n, first + wide))


def _alike(documents: list[np.ndarray], starts: np.ndarray, grid: Grid) -> Iterator[np.ndarray]:
    """Rows (owner, place, place) of grid points with equal words, GRID points at most at once, or one document's slice."""
    held, size = [], 0
    for i, d in enumerate(documents):
        for near, far in grid.pairs(len(d)) if len(d) >= LEAST else ():
            same = np.flatnonzero(d[near] == d[far])
            if size and size + len(same) > GRID:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
            if len(same):
                held.append(np.stack([np.full(len(same), i), near[same] + starts[i], far[same] + starts[i]]))
                size += len(same)
    if held:
        yield np.concatenate(held, axis=1)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Rows (owner, start, length, period): of one stretch the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]] if len(rows) else rows


def find_runs(documents: list[np.ndarray], grid: Grid) -> list[np.ndarray]:
    """(start, length, period) of all runs of each document, by start, then period. A document is an array of numbers >= 0."""
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    rows, forward, backward, n = np.empty((0, 4), np.int64), None, None, int((sizes + 1).sum())
    for owner, a, b in _alike(documents, starts, grid):
        if forward is None:
            whole = np.full(n, -1, np.int64)
            for i, d in enumerate(documents):
                whole[starts[i] : starts[i] + len(d)] = d
            marks = np.flatnonzero(whole < 0)
            whole[marks] = whole.max() + 1 + np.arange(len(marks))
            forward, backward = Extensions(whole), Extensions(whole[::-1])
        before = backward.of(n - 1 - a, n - 1 - b) - 1
        p = b - a
        length = p + forward.of(a, b) + before
        ok = np.flatnonzero((length >= 2 * p) & (length >= LEAST))
        new = np.stack([owner[ok], a[ok] - before[ok] - starts[owner[ok]], length[ok], p[ok]], axis=1)
        rows = _smallest(np.concatenate([rows, new]))
    out = [np.empty((0, 3), np.int64)] * len(documents)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else []
    for first, end in zip(cut, [*cut[1:], len(rows)], strict=True) if len(rows) else ():
        out[rows[first, 0]] = rows[first:end, 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: a word goes if a run has it after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def plant(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's planted period: the word that each word becomes, for one document of ten; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _report(doc_id, words: list[bytes], change: np.ndarray | None, runs: np.ndarray) -> tuple:
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    source = range(len(words)) if change is None else change
    source = np.asarray(source)[kept_words(len(words), runs)].tolist() if len(runs) else list(source)
    kept = b" ".join([words[k] for k in source])
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period, milli = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), start, length, period, milli, _digest(lines.encode()), _digest(kept)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, words) of documents of some BLOCK words together."""
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()  # bytes are cut at 0x20 and 0x09-0x0D alone
            if block and size + len(words) > BLOCK:
                yield block
                block, size = [], 0
            block.append((doc_id, words))
            size += len(words)
    if block:
        yield block


def _task(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid()
        for block in _blocks(batches):
            codes: dict[bytes, int] = {}
            numbers, changes = [], []
            for doc_id, words in block:
                own = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
                change = plant(len(words), doc_id) if planted else None
                changes.append(change)
                numbers.append(own if change is None else own[change])
            rows = [_report(*d, change, runs) for d, change, runs in zip(block, changes, find_runs(numbers, grid), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """A row a document: its number of runs, the longest, and digests of all runs and of the words without repeats.

    planted: first gives one document of ten a period, by the checksum of its id (the contract's test data).
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_task(planted), SCHEMA)
