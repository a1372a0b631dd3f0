"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit a component, set where it is positive.  Codes are
distinct before the search; each stands for the k smallest ids that bear it.
They are dealt into blocks of a bounded size, queries likewise, and every
block of codes is searched for every block of queries: the codes' 16-bit
segments are indexed by value, the values within radius r of a query's segment
are looked up for r = 0, 1, ..., and candidates are verified by their full
distance.  After radius r in the segments up to j (of m, from 0) every code
within m * r + j is found for certain; a query ends when its k-th verified
distance is covered, or when looking at every code is cheaper than the next
radius.  The blocks' results are merged by distance, then id.

Defined results: a null vector, or one of another length than most, has no
code: it is no neighbour and has none; ties go to the smaller id; repeated
rows count each; a query finds itself; fewer than k rows give fewer
neighbours; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.cluster import private, saved, ship

#: Codes and queries in a block; queries that are probed at a time; salts of a code's ids.
CODES, QUERIES, PROBED, SALTS = 65_536, 2_048, 256, 32
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _coder(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            good = [v is not None and len(v) == size and None not in v for v in vectors]
            bits = np.packbits(np.array([v for v, g in zip(vectors, good, strict=True) if g], np.float64).reshape(-1, size) > 0, axis=1)
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 2)))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "code"])

    return run


def codes_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code) of every row with a vector of the commonest length."""
    ship(rows.sparkSession)
    own = private(rows, {"id": id_col, "v": vector_col})
    top = own.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = top["n"] if top else 0
    return own.withColumn("id", F.col("id").cast("long")).mapInArrow(_coder(size), "id long, code binary")


def _masks(r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(16), r)], np.int64)


def search(codes: np.ndarray, queries: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) for at least all codes up to each query's k-th id; ``weight`` ids bear a code.

    ``codes`` and ``queries`` are rows of 16-bit segments.
    """
    n, m = codes.shape
    order = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
    table = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << 16))]) for j in range(m)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    for at in range(0, len(queries), PROBED):
        live = np.arange(at, min(at + PROBED, len(queries)))
        near = np.zeros((len(live), 16 * m + 1), np.int64)  # ids by distance
        seen = np.zeros((len(live), n), bool)

        def take(q: np.ndarray, c: np.ndarray, at: int = at, near: np.ndarray = near, seen: np.ndarray = seen) -> None:
            """Verify the candidates that are new to their query."""
            new = ~seen[q - at, c]
            q, c = q[new], c[new]
            seen[q - at, c] = True
            d = _BITS[queries[q] ^ codes[c]].sum(axis=1, dtype=np.int64)
            np.add.at(near, (q - at, d), weight[c])
            close = d <= (np.cumsum(near, axis=1) < k).sum(axis=1)[q - at]  # farther ones can't be among the k nearest
            found.append((q[close], c[close], d[close]))

        r = 0
        while len(live):
            masks = _masks(r)
            if len(masks) * 4 >= n or r > 16:
                for x in live:
                    take(np.full(n, x), np.arange(n))
                break
            for j in range(m):
                value = queries[live, j][:, None].astype(np.int64) ^ masks[None, :]
                lo, size = table[j][value].ravel(), (table[j][value + 1] - table[j][value]).ravel()
                total = size.sum()
                if total:
                    q = np.repeat(np.repeat(live, len(masks)), size)
                    take(q, order[j][np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)])
                done = near[live - at, : m * r + j + 1].sum(axis=1) >= k
                live = live[~done]
                if not len(live):
                    break
            r += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"code": [], "id": [], "distance": []}
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(left["code"]), ">u2").astype(np.uint16).reshape(len(left), -1)
            queries = np.frombuffer(b"".join(right["code"]), ">u2").astype(np.uint16).reshape(len(right), -1)
            ids, names = list(left["ids"]), list(right["code"])
            q, c, d = search(codes, queries, np.array([len(x) for x in ids]), k)
            by = np.lexsort((d, q))
            q, c, d = q[by], c[by], d[by]
            for a, b in zip(np.flatnonzero(np.diff(q, prepend=-1)), [*np.flatnonzero(np.diff(q)) + 1, len(q)], strict=True):
                got, last = [], None
                for x, dist in zip(c[a:b], d[a:b], strict=True):
                    if len(got) >= k and dist != last:
                        break
                    got += [(int(dist), int(i)) for i in ids[x]]
                    last = dist
                for dist, i in sorted(got)[:k]:
                    out["code"].append(names[q[a]])
                    out["id"].append(i)
                    out["distance"].append(dist)
        return pd.DataFrame(out)

    return run


def top_k(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance: for the rows where ``queries`` (over ``id``) holds, the k nearest of all."""
    codes = saved(codes_of(rows, id_col, vector_col), "codes")

    def firsts(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= k).drop("_n")

    salted = firsts(codes.where("id is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "code", "salt").drop("salt")
    index = saved(firsts(salted, "code").groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "index")
    asked = saved(codes.where(queries).distinct(), "queries")
    wanted = saved(asked.select("code").distinct(), "query-codes")
    blocks, rounds = max(1, -(-index.count() // CODES)), max(1, -(-wanted.count() // QUERIES))
    own = index.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    ask = wanted.withColumn("q", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(rounds)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = own.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInPandas(_block_search(k), "code binary, id long, distance int")
    place = W.partitionBy("code").orderBy("distance", "id")
    best = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return asked.withColumnRenamed("id", "query_id").join(best, "code").select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
