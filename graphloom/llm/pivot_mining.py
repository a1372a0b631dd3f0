"""Hard negatives by exact inner-product search over a pivot table.

Vectors are rounded to integers.  With M the longest length, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0): then |q' - x'|^2 is
|q|^2 + M^2 - 2 q.x, and the greatest inner products are the least distances.
A few rows of a bounded sample, far from one another, are the pivots; every
row's distances to them are stored beside it.  |d(q, p) - d(x, p)| and
d(q, p) + d(x, p) bracket the distance of q and x for every pivot p, and with
it the score.

Rows are dealt into blocks, anchors likewise, and every block of rows is
searched for every block of anchors.  In a block the rows of each nearest
pivot stand together, by their distance to it: whole cells fall by the least
and greatest distances of their rows, what is left of a cell is a run of rows,
rows of it fall by the other pivots, and the survivors' scores are computed
exactly.  Cells are taken by falling upper bound and the bounds that a row
must meet rise with what was found.

First each anchor's positives are found (the best other rows of its label),
then, for each anchor and positive, the best rows of other labels whose score
lies within shares of the positive's.

Defined results: rows without an id or label, without a vector, with a null or
non-finite component, or with a squared length of 2**62 or more (their scores
need not fit 64 bits) take no part; rows of one id are one row, that of the
least label, then vector; of vectors of different lengths the common
components count, and an empty vector scores 0; an anchor without positives,
or a positive without negatives, has no row; ties go to the smaller id; an
empty table gives an empty table; extra columns, and doubled names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.cluster import lean, private, saved, ship

#: Rows and anchors of a block; pivots and the rows that they are taken from.
ROWS, ANCHORS, PIVOTS, SAMPLE = 32_768, 16_384, 16, 512
_LIMIT = 2.0**62


def _rounded(scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)  # nulls are NaN
                ends = np.cumsum(size)
                total = np.concatenate([[0], np.cumsum(np.where(np.abs(flat) < 2.0**31, 0, 1))])
                good = total[ends] == total[ends - size]
                flat[~(np.abs(flat) < 2.0**31)] = 0
            norm = np.array([float(flat[e - s : e] @ flat[e - s : e]) for s, e in zip(size, ends, strict=True)])
            good &= norm < _LIMIT
            good &= v.is_valid().to_numpy(zero_copy_only=False)
            raw = flat.astype("<i4").tobytes()
            kept = pa.array(good)
            vectors = [raw[4 * (e - s) : 4 * e] for s, e, g in zip(size, ends, good, strict=True) if g]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(kept), batch.column("label").filter(kept), pa.array(vectors, pa.binary()), pa.array(norm[good])], names=["id", "label", "v", "norm"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array, wide: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros and longer ones cut to ``wide``."""
    vectors = [np.frombuffer(b, "<i4") for b in column.to_pylist()]
    wide = max(map(len, vectors), default=0) if wide is None else wide
    out = np.zeros((len(vectors), wide))
    for i, x in enumerate(vectors):
        out[i, : min(wide, len(x))] = x[:wide]
    return out


def _apart(vectors: np.ndarray, norm: np.ndarray, top: float, most: int) -> list[int]:
    """Places of rows far from one another: each the farthest from those before it."""
    own = np.sqrt(np.maximum(top - norm, 0))
    chosen, near = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(most, len(vectors)):
        p = chosen[-1]
        near = np.minimum(near, 2 * top - 2 * (vectors @ vectors[p] + own * own[p]))
        at = int(near.argmax())
        if near[at] <= 0:
            break
        chosen.append(at)
    return chosen


class PivotBlock:
    """A block of rows by cells of their nearest pivot, with their distances to all pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, far: np.ndarray, top: float):
        own = far.argmin(axis=1)
        by = np.lexsort((far[np.arange(len(own)), own], own))
        self.ids, self.labels, self.vectors, self.far, own = ids[by], labels[by], vectors[by], far[by], own[by]
        self.pivot, self.first = np.unique(own, return_index=True)
        self.last = np.append(self.first[1:], len(own))
        self.near = self.far[np.arange(len(own)), own]
        self.least, self.most = np.minimum.reduceat(self.far, self.first), np.maximum.reduceat(self.far, self.first)
        self.top, self.slack = top, 4e-6 * np.sqrt(top) + 1e-9
        self.reach = np.abs(vectors).max(initial=0)
        self.exact = self.skipped = 0

    def cells(self, away: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and least score that a row of each cell can have, of an anchor with these distances to the pivots."""
        low = np.maximum(np.maximum(away - self.most, self.least - away).max(axis=1) - self.slack, 0)
        high = (away + self.most).min(axis=1) + self.slack
        return (norm + self.top - low * low) / 2 + 1, (norm + self.top - high * high) / 2 - 1

    def survivors(self, c: int, away: np.ndarray, norm: float, least: float, most: float) -> np.ndarray:
        """The rows of a cell whose brackets reach into scores from ``least`` to ``most``."""
        a, b, p = self.first[c], self.last[c], self.pivot[c]
        far = np.sqrt(max(norm + self.top - 2 * least, 0)) + self.slack if least > -np.inf else np.inf
        close = np.sqrt(max(norm + self.top - 2 * most, 0)) - self.slack if most < np.inf else 0
        near = self.near[a:b]
        lo = a + np.searchsorted(near, max(away[p] - far, close - away[p]), "left")
        hi = a + np.searchsorted(near, away[p] + far, "right")
        self.skipped += b - a - max(hi - lo, 0)
        if hi <= lo:
            return np.zeros(0, np.int64)
        keep = (np.abs(self.far[lo:hi] - away).max(axis=1) <= far) & ((self.far[lo:hi] + away).min(axis=1) >= close)
        self.skipped += int((~keep).sum())
        return lo + np.flatnonzero(keep)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        self.exact += len(at)
        if self.vectors.shape[1] * self.reach * np.abs(q).max(initial=0) < 2.0**53:
            return (self.vectors[at] @ q).astype(np.int64)
        return self.vectors[at].astype(np.int64) @ q.astype(np.int64)  # sums may wrap on the way, the result fits

    def best(self, q: np.ndarray, away: np.ndarray, norm: float, allowed: Callable[[np.ndarray], np.ndarray], windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores its k best (-score, id) among the allowed rows."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        need = [lo for lo, _ in windows]
        most = max(hi for _, hi in windows)
        upper, lower = self.cells(away, norm)
        for c in np.argsort(-upper):
            least = min(need)
            if upper[c] < least:
                break
            if lower[c] > most:
                continue
            at = self.survivors(c, away, norm, least, most)
            at = at[allowed(at)]
            if not len(at):
                continue
            s, ids = self.scores(at, q), self.ids[at]
            for w, (_, hi) in enumerate(windows):
                fit = np.flatnonzero((s >= need[w]) & (s <= hi))
                if len(fit):
                    first = fit[np.lexsort((ids[fit], -s[fit]))[:k]]
                    found[w] = sorted(found[w] + [(-int(s[i]), int(ids[i])) for i in first])[:k]
                    if len(found[w]) == k:
                        need[w] = max(need[w], -found[w][-1][0])
        return found


def _distances(pivots: np.ndarray, pivot_norm: np.ndarray, top: float) -> Callable:
    """Adds every row's distances to the pivots, both with their further component."""
    own = np.sqrt(np.maximum(top - pivot_norm, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            dot = _matrix(batch.column("v"), pivots.shape[1]) @ pivots.T + np.sqrt(np.maximum(top - norm, 0))[:, None] * own
            far = np.sqrt(np.maximum(2 * top - 2 * dot, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in far], pa.binary())], names=[*batch.schema.names, "far"])

    return run


def _block_search(pivots: np.ndarray, top: float, schema: pa.Schema, ask: Callable) -> Callable:
    """``ask(block, anchor row, its vector, its distances)`` for every anchor of a block of them, on a block of rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors = _matrix(left["v"])
            far = np.frombuffer(b"".join(left["far"].to_pylist())).reshape(left.num_rows, -1)
            block = PivotBlock(left["id"].to_numpy(), left["label"].to_numpy(), vectors, far, top)
            asked, norm = _matrix(right["v"], max(vectors.shape[1], pivots.shape[1])), right["norm"].to_numpy()
            away = np.sqrt(np.maximum(norm[:, None] + top - 2 * asked[:, : pivots.shape[1]] @ pivots.T, 0))
            own = np.ascontiguousarray(asked[:, : vectors.shape[1]])
            for i, row in enumerate(right.drop_columns(["v", "norm"]).to_pylist()):
                out += ask(block, row, own[i], away[i], norm[i])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def _positives(k: int) -> Callable:
    def ask(block: PivotBlock, row: dict, q: np.ndarray, away: np.ndarray, norm: float) -> list[tuple]:
        allowed = lambda at: (block.labels[at] == row["label"]) & (block.ids[at] != row["id"])
        return [(row["id"], i, -s) for s, i in block.best(q, away, norm, allowed, [(-np.inf, np.inf)], k)[0]]

    return ask


def _negatives(k: int, low: int, high: int) -> Callable:
    def ask(block: PivotBlock, row: dict, q: np.ndarray, away: np.ndarray, norm: float) -> list[tuple]:
        pairs = [(p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in row["positives"]]
        pairs = [p for p in pairs if p[2] <= p[3]]
        if not pairs:
            return []
        found = block.best(q, away, norm, lambda at: block.labels[at] != row["label"], [(lo, hi) for *_, lo, hi in pairs], k)
        return [(row["id"], p, i, score, -s) for (p, score, *_), near in zip(pairs, found, strict=True) for s, i in near]

    return ask


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for the rows where ``anchors`` (over ``id``) holds.

    A negative's score is from ``low`` to ``high`` per cent of the positive's.
    """
    ship(rows.sparkSession)
    own = private(rows, {"id": id_col, "label": label_col, "v": vector_col}).where("id is not null and label is not null and v is not null")
    typed = own.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    whole = typed.mapInArrow(lean(_rounded(scale)), "id long, label long, v binary, norm double")
    one = saved(whole.groupBy("id").agg(F.min(F.struct("label", "v", "norm")).alias("r")).select("id", "r.*"), "vectors")
    top, n = one.agg(F.max("norm"), F.count("*")).first()
    sample = one.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", "norm").toArrow()
    vectors, norm = _matrix(sample["v"]), sample["norm"].to_numpy()
    at = _apart(vectors, norm, top or 0.0, PIVOTS) if len(vectors) else []
    pivots = vectors[at]
    table = saved(one.mapInArrow(lean(_distances(pivots, norm[at], top or 0.0)), "id long, label long, v binary, norm double, far binary"), "pivot-table")
    asked = saved(one.where(anchors), "anchors")
    blocks, rounds = max(1, -(-n // block_rows)), max(1, -(-asked.count() // block_anchors))

    def searched(anchors: DataFrame, ask: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
        left = table.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        right = anchors.withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_block_search(pivots, top or 0.0, schema, ask), ddl)

    long = pa.int64()
    near = searched(asked, _positives(positives), pa.schema([("anchor_id", long), ("id", long), ("score", long)]), "anchor_id long, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    best = near.withColumn("n", place).where(F.col("n") <= positives)
    each = saved(best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("positives")), "positives")
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    far = searched(asked.join(each, "id"), _negatives(negatives, low, high), pa.schema([(c, long) for c in names]), ", ".join(f"{c} long" for c in names))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
