"""Ranked lexical search by MaxScore over the shards of an inverted index.

The terms that items ask for are gathered first, in rounds of a bounded size.
A round reads all texts once, in place: a task cuts its rows into shards of a
bounded number of postings and documents, and writes for each the posting
lists of the asked terms (documents ascending, occurrences), the documents'
ids and lengths, and for each list the shortest document of each number of
occurrences, from which the list's highest part of a score is exact.  Numbers
of documents and words, and each term's documents, are sums over the shards.

A shard is then searched for all items of the round.  Lists go by falling
upper bound; they are essential, and any of their documents is taken up, until
the bounds of those that are left add up to less than the k-th best score.
Those are non-essential: only documents that can still qualify are looked up
in them, and fewer with each list.  A task carries its k-th scores from shard
to shard.  The tasks' best are merged by score, then id.

Terms are runs of ASCII letters and digits and of all other characters beyond
ASCII; only A-Z is folded.  They are found by hash and then compared byte by
byte.

Defined results: a null or empty text has no term and counts nowhere; a text
of any length is read whole; rows of one id are documents of their own; rows
without an id are ranked, after others of the same score; rows of one item are
one item, with the terms of all, those without an id too; items without a
match have no rows; empty tables give an empty table; extra columns, and
doubled names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.cluster import dropped, lean, private, saved, ship
from graphloom.llm.textkernel import Words, as_bytes, chunks

#: Postings and documents of a shard; bytes of asked terms in a round (about); salts of an item's candidates.
POSTINGS, DOCS, ROUND, SALTS = 1 << 21, 1 << 16, 16 << 20, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that stand in no term.
_PARTS = np.ones(256, np.uint8)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INDEX = "docs long, words long, ids array<bigint>, sizes binary, terms binary, ends binary, at binary, tf binary, peak_ends binary, peak_tf binary, peak_size binary"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Lexicon:
    """Finds the asked terms among the words of texts."""

    def __init__(self, terms: list[bytes]):
        w = Words(terms, parts=_PARTS)
        h = w.hashes()
        order = np.argsort(h, kind="stable")
        self.hashes, self.number = h[order], order
        self.blob, self.starts, self.sizes = w.blob, w.starts, w.ends - w.starts

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and (text, term) of each asked word."""
        w = Words(texts, parts=_PARTS)
        n = np.diff(w.first)
        if not len(self.hashes) or not len(w.starts):
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = w.hashes()
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[k] == h)
        term, size = self.number[k[hit]], (w.ends - w.starts)[hit]
        same = self.sizes[term] == size
        hit, term, size = hit[same], term[same], size[same]
        if len(hit):
            differ = _FOLD[w.blob[_ranges(w.starts[hit], size)]] != self.blob[_ranges(self.starts[term], size)]
            same = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
            hit, term = hit[same], term[same]
        return n, np.searchsorted(w.first, hit, "right") - 1, term


class _Shard:
    """The postings of some documents of a task, until they are written."""

    def __init__(self):
        self.docs = self.words = self.size = 0
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list, n: np.ndarray, text: np.ndarray, term: np.ndarray, wide: int) -> None:
        self.docs += int((n > 0).sum())
        self.words += int(n.sum())
        pair, tf = np.unique(text * wide + term, return_counts=True)
        doc, term = pair // wide, pair % wide
        has, place = np.unique(doc, return_inverse=True)
        self.parts.append(((place + len(self.ids)).astype(np.uint16), term.astype(np.int32), tf.astype(np.int32)))
        self.ids += [ids[i] for i in has]
        self.lengths.append(n[has])
        self.size += len(pair)

    def batch(self) -> pa.RecordBatch:
        at, term, tf = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts, strict=True) if self.parts else ((),) * 3))
        size = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        by = np.argsort(term, kind="stable")  # documents stay ascending
        at, term, tf = at[by], term[by], tf[by]
        terms, first = np.unique(term, return_index=True)
        ends = np.append(first, len(term))[1:]
        n = size[at]
        by = np.lexsort((n, tf, term))
        new = np.flatnonzero((np.diff(term[by], prepend=-1) != 0) | (np.diff(tf[by], prepend=-1) != 0))
        peak = by[new]  # for each term and number of occurrences the shortest document
        columns = [size, terms.astype(np.int32), ends, at.astype(np.uint16), tf.astype(np.int32), np.searchsorted(term[peak], terms, "right"), tf[peak].astype(np.int32), n[peak]]
        as_binary = [pa.array([c.tobytes()], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([self.docs]), pa.array([self.words]), pa.array([self.ids], pa.list_(pa.int64())), *as_binary], names=[c.split()[0] for c in _INDEX.split(", ")])


def _indexer(terms: list[bytes], postings: int, docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, shard = Lexicon(terms), _Shard()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), as_bytes(batch.column("text"))
            for at, some in chunks(texts):
                for k in range(0, len(some), docs):  # a chunk of tiny texts has many
                    part = some[k : k + docs]
                    n, text, term = lexicon.found(part)
                    if shard.size >= postings or len(shard.ids) + len(part) > docs:
                        yield shard.batch()
                        shard = _Shard()
                    shard.add(ids[at + k : at + k + len(part)], n, text, term, max(len(terms), 1))
        if shard.docs:
            yield shard.batch()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(ends, np.int64), prepend=0))], names=["term", "n"])


class ShardSearch:
    """MaxScore over the lists of one shard; ``weight`` is by term, ``docs`` and ``words`` are of all shards."""

    def __init__(self, row: dict, weight: np.ndarray, docs: int, words: int):
        take = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = row["ids"]
        self.order = np.array([(i is None, i or 0) for i in self.ids], [("none", bool), ("id", np.int64)])
        self.at, self.tf, self.ends = take("at", np.uint16), take("tf", np.int32), take("ends", np.int64)
        self.floor = 10 + (90 * docs * take("sizes", np.int64)) // words
        terms, tf, size, ends = take("terms", np.int32), take("peak_tf", np.int32).astype(np.int64), take("peak_size", np.int64), take("peak_ends", np.int64)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * docs * size) // words))
        best = np.maximum.reduceat(part, ends - np.diff(ends, prepend=0)) if len(ends) else ends
        self.weight, self.best = weight[terms], best * weight[terms]
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.scores = np.zeros(len(self.ids), np.int64)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.probed = self.merged = 0

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of list i and their parts of a score."""
        if i not in self.known:
            a, b = self.ends[i - 1] if i else 0, self.ends[i]
            at, tf = self.at[a:b], self.tf[a:b].astype(np.int64)
            self.known[i] = at, self.weight[i] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.floor[at]))
        return self.known[i]

    def top(self, terms: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) and scores of at least the k best with ``least`` or more, ids deciding ties."""
        lists = [i for t in terms if (i := self.place.get(int(t))) is not None and self.best[i] > 0]
        lists.sort(key=lambda i: -self.best[i])
        rest = np.append(np.cumsum(self.best[lists][::-1])[::-1], 0) if lists else np.zeros(1, np.int64)
        scores, j = self.scores, 0
        scores[:] = 0
        while j < len(lists) and rest[j] >= least:  # essential
            at, part = self.postings(lists[j])
            scores[at] += part
            self.merged += len(at)
            j += 1
            if k <= len(scores) and rest[j] < scores.max(initial=0):
                least = max(least, int(np.partition(scores, -k)[-k]))
        live = np.flatnonzero((scores > 0) & (scores + rest[j] >= least))
        for x in range(j, len(lists)):  # non-essential
            if not len(live):
                break
            at, part = self.postings(lists[x])
            spot = np.minimum(np.searchsorted(at, live), len(at) - 1)
            here = at[spot] == live
            scores[live[here]] += part[spot[here]]
            self.probed += len(live)
            if k <= len(live):
                least = max(least, int(np.partition(scores[live], -k)[-k]))
            live = live[scores[live] + rest[x + 1] >= least]
        live = live[scores[live] >= least]
        best = live[np.lexsort((self.order["id"][live], self.order["none"][live], -scores[live]))][:k]
        return best, scores[best].copy()


def _searcher(items: list, asked: list[np.ndarray], weight: np.ndarray, docs: int, words: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardSearch(row, weight, docs, words)
                for q, terms in enumerate(asked):
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    at, score = shard.top(terms, k, least)
                    if len(at):
                        new = [(-int(s), shard.ids[a] is None, shard.ids[a] or 0) for a, s in zip(at, score, strict=True)]
                        best[q] = sorted(best[q] + new)[:k]
        rows = [(q, None if none else i, -s) for q, found in enumerate(best) for s, none, i in found]
        if rows:
            q, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([items[x] for x in q], kind), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def rounds_of(asked: DataFrame, most: int = ROUND) -> tuple[DataFrame, int]:
    """``asked`` (item_id, term) with the round of each item, none of many items above twice ``most`` bytes, and the number of rounds."""
    size = F.octet_length("term") + 8
    rounds = max(1, -(-(asked.agg(F.sum(size)).first()[0] or 0) // most))
    while True:
        dealt = asked.withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds)).cast("int"))
        sizes = dealt.groupBy("round", "item_id").agg(F.sum(size).alias("b")).groupBy("round").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
        if rounds == 1 or sizes.where((F.col("b") > 2 * most) & (F.col("n") > 1)).isEmpty():
            return dealt, rounds
        rounds *= 2


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", postings: int = POSTINGS, shard_docs: int = DOCS, round_bytes: int = ROUND) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    own = private(docs, {"id": id_col, "text": text_col}).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wanted = private(items, {"item_id": item_col, "text": item_text_col}).select("item_id", F.explode(terms_of(F.col("text").cast("string"))).alias("term"))
    asked, rounds = rounds_of(saved(wanted.distinct(), "asked"), round_bytes)
    key = asked.schema["item_id"].dataType
    near = asked.select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    for r in range(rounds):
        rows = asked.where(F.col("round") == r).select("item_id", "term").collect()  # a round is bounded
        if not rows:
            continue
        terms = sorted({x["term"].encode() for x in rows})
        number = {t: i for i, t in enumerate(terms)}
        by_item: dict = {}
        for x in rows:
            by_item.setdefault(x["item_id"], []).append(number[x["term"].encode()])
        index = saved(own.mapInArrow(lean(_indexer(terms, postings, shard_docs)), _INDEX), "postings")
        docs_n, words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        if words:
            weight = np.zeros(len(terms), np.int64)
            counts = index.select("terms", "ends").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
            for term, df in counts.collect():  # at most a round's terms
                weight[term] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))
            found = index.mapInArrow(lean(_searcher(list(by_item), [np.array(sorted(x)) for x in by_item.values()], weight, docs_n, words, k, to_arrow_type(key))), near.schema)
            near = near.unionByName(saved(found, "found"))
        dropped(index)
    return best_of(near, k)


def best_of(near: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each item, first within salts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = near.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("n") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
