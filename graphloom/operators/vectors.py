"""Vector search: exact by blocks, and an inverted index over trained cells.

Vectors of another length than most, and those with a null or non-finite
component, take no part, nor do rows without a vector.

Exact search lays blocks of rows against blocks of queries: a block holds
32,768 rows or 16,384 queries, so rows travel once for each 16,384 queries, a
task makes one matrix product after another and gives the k nearest of its
block, and these are merged by rank.

The index is trained by Lloyd's rounds over all rows: a task adds its vectors
up by nearest centre, Spark adds the tasks' sums, and a centre without rows
stays where it is.  Centres go to tasks in groups of at most ``CENTRES`` bytes;
more than that are met group after group in the same pass, each row taking
along the nearest so far, so no number of cells is too large.  A cell's rows
stand together in files; a search reads only the cells that some query probes
(a semi-join), and large cells are cut into blocks of rows, and of queries, so
no task receives a whole one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.lineage import cut

#: Rows and queries of a block; queries of one matrix product; bytes of centres that go to a task at a time.
ROWS, ASKED, AT_ONCE, CENTRES = 32_768, 16_384, 256, 64 << 20


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows with a finite vector of the commonest length, of equally common ones the longest."""
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    good = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("v") == (top["n"] if top else -1))


def _matrix(v: pd.Series | pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(v, pd.Series):
        return np.array(v.tolist(), np.float64).reshape(len(v), -1)
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    return pc.list_flatten(v).to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def distances(asked: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances, or one less the cosine (one where a vector is zero)."""
    dot = asked @ rows.T
    if metric == "l2":
        return np.maximum((asked * asked).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * dot, 0)
    size = np.sqrt((asked * asked).sum(axis=1)[:, None] * (rows * rows).sum(axis=1))
    return 1 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)


def _nearest_of_blocks(k: int, metric: str) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            rows, ids = _matrix(left["v"]), left["id"].to_numpy()
            asked, names = _matrix(right["v"]), right["query"].to_numpy()
            for at in range(0, len(asked), AT_ONCE):
                d = np.round(distances(asked[at : at + AT_ONCE], rows, metric), 6) + 0.0
                least = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
                q, r = np.nonzero(d <= least[:, None])  # all that tie with the k-th
                by = np.lexsort((ids[r], d[q, r], q))
                q, r = q[by], r[by]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[place < k], r[place < k]
                out.append((names[at + q], ids[r], d[q, r]))
        query, near, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(query, pa.int64()), "id": pa.array(near, pa.int64()), "distance": pa.array(d, pa.float64())})

    return run


def merged(near: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def nearest(rows: DataFrame, asked: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "l2", block: int = ROWS, asked_block: int = ASKED) -> DataFrame:
    """(query, id, distance, rank): exact search of ``asked`` (rows of the same columns) among ``rows``."""
    own, ask = usable(rows, id_col, vector_col), usable(asked, id_col, vector_col).withColumnRenamed("id", "query")
    blocks, rounds = max(1, -(-own.count() // block)), max(1, -(-ask.count() // asked_block))
    left = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    right = ask.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(rounds)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_nearest_of_blocks(k, metric), "query long, id long, distance double")
    return merged(near, k)


# ---- trained cells ----------------------------------------------------------------


def _groups(centres: DataFrame, bytes_: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, vectors) of the centres (cell, c), so many bytes at a time."""
    n, first = centres.count(), centres.first()
    wide = len(first["c"]) if first else 0
    most = max(1, bytes_ // max(1, 8 * wide))
    for at in range(0, n, most):
        part = centres.where(F.col("cell").between(at, at + most - 1)).orderBy("cell").toPandas()
        yield part["cell"].to_numpy(np.int64), _matrix(part["c"])


def assigned(rows: DataFrame, centres: DataFrame, probes: int = 1, centre_bytes: int = CENTRES) -> DataFrame:
    """(id, v, cells): the ``probes`` nearest cells of each row (id, v), nearest first; ties go to the smaller number.

    ``cells`` are structs of distance and number; cells are numbered from 0 on.
    """
    out = rows.withColumn("cells", F.expr("cast(array() as array<struct<d: double, cell: bigint>>)"))
    kind = "id long, v array<double>, cells array<struct<d: double, cell: bigint>>"

    def step(numbers: np.ndarray, vectors: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, so_far = _matrix(batch.column("v")), batch.column("cells").to_pylist()
                cells: list[list[dict]] = []
                for at in range(0, len(v), AT_ONCE):
                    d = distances(v[at : at + AT_ONCE], vectors, "l2")
                    few = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
                    for i, near in enumerate(few):
                        new = [{"d": float(d[i, j]), "cell": int(numbers[j])} for j in near]
                        cells.append(sorted(so_far[at + i] + new, key=lambda s: (s["d"], s["cell"]))[:probes])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells, batch.schema.field("cells").type)], schema=batch.schema)

        return run

    for numbers, vectors in _groups(centres, centre_bytes):
        out = out.mapInArrow(step(numbers, vectors), kind)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows by cell: their number and the sums of their components."""
    cells, totals, counts = np.zeros(0, np.int64), None, None
    for batch in batches:
        if batch.num_rows:
            at, v = batch.column("cell").to_numpy(), _matrix(batch.column("v"))
            keys, place = np.unique(np.concatenate([cells, at]), return_inverse=True)
            total, count = np.zeros((len(keys), v.shape[1])), np.zeros(len(keys), np.int64)
            if len(cells):
                total[place[: len(cells)]], count[place[: len(cells)]] = totals, counts
            np.add.at(total, place[len(cells) :], v)
            np.add.at(count, place[len(cells) :], 1)
            cells, totals, counts = keys, total, count
    if len(cells):
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts), pa.array(list(totals), pa.list_(pa.float64()))], names=["cell", "n", "s"])


def first_centres(rows: DataFrame, cells: int) -> DataFrame:
    """(cell, c): the vectors of the rows whose ids have the smallest MD5, in that order."""
    few = rows.withColumn("h", F.md5(F.col("id").cast("string"))).orderBy("h", "id").limit(cells)
    numbered = few.withColumn("cell", F.row_number().over(W.orderBy("h", "id")).cast("long") - 1)  # of the few alone
    return numbered.select("cell", F.col("v").alias("c"))


def trained(rows: DataFrame, cells: int, rounds: int, centre_bytes: int = CENTRES) -> DataFrame:
    """(cell, c): centres of ``rows`` (id, v) after so many rounds of Lloyd's algorithm."""
    centres = cut(first_centres(rows, cells), "centres")
    for _ in range(rounds):
        near = assigned(rows, centres, 1, centre_bytes).select(F.get("cells", F.lit(0))["cell"].alias("cell"), "v")
        parts = near.mapInArrow(_sums, "cell long, n long, s array<double>")
        by_place = parts.select("cell", "n", F.posexplode("s").alias("i", "x")).groupBy("cell", "i").agg((F.sum("x") / F.sum("n")).alias("m"))
        moved = by_place.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("new"))
        centres = cut(centres.join(moved, "cell", "left").select("cell", F.coalesce("new", "c").alias("c")), "centres")
    return centres


class CellIndex:
    """An inverted index over trained cells: ``centres`` (cell, c) and ``lists`` (cell, id, v), rows of a cell together."""

    def __init__(self, centres: DataFrame, lists: DataFrame, centre_bytes: int = CENTRES):
        self.centres, self.lists, self.centre_bytes = centres, lists, centre_bytes

    @staticmethod
    def built(rows: DataFrame, id_col: str, vector_col: str, cells: int | None = None, rounds: int = 4, centre_bytes: int = CENTRES) -> CellIndex:
        """Train on all rows and file them; without a number of cells the square root of the rows, at most 100."""
        own = cut(usable(rows, id_col, vector_col), "vectors")
        n = own.count()
        cells = min(100, max(1, math.isqrt(n))) if cells is None else cells
        centres = trained(own, cells, rounds, centre_bytes)
        filed = assigned(own, centres, 1, centre_bytes).select(F.get("cells", F.lit(0))["cell"].alias("cell"), "id", "v")
        lists = cut(filed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "lists")
        return CellIndex(centres, lists, centre_bytes)

    def search(self, asked: DataFrame, id_col: str, vector_col: str, k: int, probes: int, metric: str = "l2", block: int = ROWS, asked_block: int = ASKED) -> DataFrame:
        """(query, id, distance, rank): the k nearest in the ``probes`` cells nearest to each query."""
        ask = usable(asked, id_col, vector_col)
        probed = assigned(ask, self.centres, probes, self.centre_bytes).select(F.col("id").alias("query"), "v", F.explode("cells").alias("s"))
        probed = cut(probed.select("query", "v", F.col("s.cell").alias("cell")), "probed")
        wanted = self.lists.join(probed.select("cell").distinct(), "cell", "left_semi")
        sizes = wanted.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
        rounds = probed.groupBy("cell").agg(F.ceil(F.count("*") / asked_block).alias("rounds"))
        shape = cut(sizes.join(rounds, "cell"), "shape")
        left = wanted.join(shape, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
        right = probed.join(shape, "cell").withColumn("q", F.pmod(F.xxhash64("query"), F.col("rounds"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        near = left.select("cell", "b", "q", "id", "v").groupBy("cell", "b", "q").cogroup(right.select("cell", "b", "q", "query", "v").groupBy("cell", "b", "q")).applyInArrow(_nearest_of_blocks(k, metric), "query long, id long, distance double")
        return merged(near, k)

    def calibrated(self, asked: DataFrame, id_col: str, vector_col: str, k: int, target: float = 0.9, sample: int = 256, metric: str = "l2") -> int:
        """The number of probes that finds ``target`` of the exact neighbours of at most ``sample`` queries (by hash of their ids)."""
        few = cut(asked.orderBy(F.xxhash64(id_col), id_col).limit(sample), "sample")
        exact = cut(nearest(self.lists, few.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "id", "v", k, metric), "exact")
        cells, probes = self.centres.count(), 1
        while probes < cells and recall(self.search(few, id_col, vector_col, k, probes, metric), exact) < target:
            probes *= 2
        return min(probes, cells)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query, id) that are found."""
    both = exact.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
