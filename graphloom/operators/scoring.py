"""Scores of documents for all queries of a round, inside the tasks that hold the documents.

A pair of a document and a query is nowhere a row: a task adds up its documents'
scores in arrays, some million pairs at a time, and keeps the best of each
query, which are merged by rank.  So what is shuffled grows with the queries and
the tasks, not with their pairs.  Words add up in a fixed order, so equal
documents have equal scores wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries of a round; pairs that a task scores at once.
ROUND, PAIRS = 2048, 1 << 21
HITS = "query long, id long, score double"


def members(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of an array of lists, and the row of each."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), n)


def counted(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, word, how often): the distinct words of each row, by row."""
    flat, row = members(lists)
    words = flat.dictionary_encode()
    size = max(1, len(words.dictionary))
    key, n = np.unique(row * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return key // size, words.dictionary.take(pa.array(key % size)), n


def in_lists(rows: np.ndarray, size: int, values: pa.Array) -> pa.Array:
    """Values of ascending rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(size + 1)), pa.int32()), values)


def numbers(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of words in a list of known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


class Links:
    """From each of ``size`` sources to targets with a factor, of rows (source, target, factor)."""

    def __init__(self, source: list[int], target: list[int], factor: list[float], size: int, targets: int):
        s, t = np.array(source, np.int64), np.array(target, np.int64)
        order = np.lexsort((t, s))
        self.target, self.factor, self.targets = t[order], np.array(factor, float)[order], targets
        self.first = np.searchsorted(s[order], np.arange(size + 1))

    def reach(self, source: np.ndarray) -> np.ndarray:
        """How many targets each has."""
        return self.first[source + 1] - self.first[source]

    def spread(self, row: np.ndarray, source: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows x targets) sums of value times factor, and how many there are."""
        n = self.reach(source)
        ends = np.cumsum(n)
        at = np.repeat(self.first[source] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        key = np.repeat(row, n) * self.targets + self.target[at]
        cells = rows * self.targets
        return np.bincount(key, np.repeat(value, n) * self.factor[at], cells), np.bincount(key, minlength=cells)


def chunks(row: np.ndarray, cost: np.ndarray, rows: int, each: int) -> Iterator[tuple[int, int, slice]]:
    """(first row, end row, their places): runs of rows that cost about ``PAIRS``; a row costs ``each`` and its places' cost."""
    total = np.cumsum(each + np.bincount(row, cost, rows))
    edges = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), rows]
    places = np.searchsorted(row, edges)
    for a, b, i, j in zip(edges, edges[1:], places, places[1:], strict=False):
        if j > i:
            yield a, b, slice(i, j)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Best:
    """The first ``top`` of each query by descending score, then id."""

    def __init__(self, queries: np.ndarray, top: int):
        self.queries, self.top = queries, top
        self.floor = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        self.held.append((query[keep], ids[keep], score[keep]))
        self.size += int(keep.sum())
        if self.size > max(PAIRS, 2 * len(self.queries) * self.top):
            self.settle()

    def settle(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.top - 1
        self.floor[q[last]] = s[last]
        keep = place < self.top
        self.held, self.size = [(q[keep], i[keep], s[keep])], int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.settle()
            q, i, s = self.held[0]
            for a in range(0, len(q), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.queries[q[b]], pa.int64()), pa.array(i[b], pa.int64()), pa.array(s[b], pa.float64())], names=["query", "id", "score"])


def scorer(queries: list[int], top: int, score: Callable) -> Callable:
    """A task's work: ``score(batch, best)`` for slices of its batches, then the best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(np.array(queries, np.int64), top)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                score(batch.slice(at, 1024), best)
        yield from best.rows()

    return run
