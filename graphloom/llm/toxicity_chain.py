"""Toxicity by a classifier chain of linear models over hashed words.

The categories are predicted one after the other.  Each model is a logistic
regression with an L1 penalty that sees the words of the text (runs of letters,
A-Z lower-cased, hashed, and
their first bytes; present or not) and the probabilities of all
categories before its own.  In training those are out-of-fold: predicted by
models that were fitted on the other folds, so later models learn from
probabilities as they will meet them.

The models are fitted on at most about ``SAMPLE`` labelled rows, picked by a
hash of the id, which the driver holds as lists of word hashes (4 bytes each).
Every document is scored, on its whole text, where it lies.

Defined results: a null or empty text has no words and gets the model's
intercept; labels with null in the id or a category, or without a document,
are not used; of labels of one id one is used; without labels of both values
in a category its probability is the share of ones seen (0 if none); repeated
rows each get a result; an empty table gives an empty table; extra columns are
ignored or, with ``keep``, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.cluster import lean, private, ship
from graphloom.llm.textkernel import NO_LETTER, Words, as_bytes, chunks

#: Bytes of a word's start that are features, the whole word last.
STEMS = (6, 7, 8, 1 << 20)
#: Labelled rows that a fit uses at most (about), folds, hashed word places.
SAMPLE, FOLDS, PLACES = 16_000, 3, 1 << 18
#: Words that a model sees (those most correlated with its category), in so many texts at least; L1 penalty by a
#: feature's deviation; steps.
FEATURES, LEAST_TEXTS, PENALTY, STEPS = 4_096, 4, 0.002, 300
#: A category is predicted from this probability on.
THRESHOLD = 0.5


def word_places(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashed words and stems of each text."""
    for _, run in chunks(texts):
        w = Words(run, parts=NO_LETTER)
        h = (w.hashes(*STEMS) & np.uint64(PLACES - 1)).astype(np.int64)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            yield np.unique(h[:, a:b])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.astype("<i4").tobytes() for x in word_places(as_bytes(batch.column("text")))]
        yield batch.drop_columns(["text"]).append_column("words", pa.array(rows, pa.binary()))


class Linear:
    """A logistic model: weights by hashed word, weights of earlier categories, intercept."""

    def __init__(self, words: np.ndarray, before: np.ndarray, start: float):
        self.words, self.before, self.start = words, before, start

    def __call__(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        sums = np.array([self.words[r].sum() for r in rows]) if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.start + sums + before @ self.before, -30, 30)))


def fit_linear(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    """Accelerated proximal gradient descent on the penalised log-loss."""
    n, extra = len(rows), before.shape[1]
    words = np.zeros(PLACES)
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return Linear(words, np.zeros(extra), 30.0 * (1 if share else -1))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    df = np.bincount(flat, minlength=PLACES)
    with_y = np.bincount(flat[(y > 0.5)[owner]], minlength=PLACES)
    mean = df / n
    lift = np.abs(with_y / n - mean * y.mean()) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    lift[(df < LEAST_TEXTS) | (mean > 0.5)] = 0
    pick = np.sort(np.argsort(-lift, kind="stable")[:FEATURES])
    pick = pick[lift[pick] > 0]
    place = np.full(PLACES, -1, np.int32)
    place[pick] = np.arange(len(pick), dtype=np.int32)
    col = place[flat]
    del flat
    owner, col = owner[col >= 0], col[col >= 0]
    k = len(pick)
    w, start = np.zeros(k + extra), np.log(y.mean() / (1 - y.mean()))
    look, look0, t, bound = w.copy(), start, 1.0, 1.0
    penalty = np.concatenate([PENALTY * np.sqrt(mean[pick] * (1 - mean[pick])), np.zeros(extra)])

    def margin(v: np.ndarray, v0: float) -> np.ndarray:
        return v0 + np.bincount(owner, weights=v[col], minlength=n) + before @ v[k:]

    def loss(m: np.ndarray) -> float:
        return float((np.logaddexp(0, m) - y * m).mean())

    for _ in range(STEPS):
        m = margin(look, look0)
        r = (1 / (1 + np.exp(-m)) - y) / n
        g = np.concatenate([np.bincount(col, weights=r[owner], minlength=k), before.T @ r])
        g0, at = r.sum(), loss(m)
        while True:
            step = look - g / bound
            step = np.sign(step) * np.maximum(np.abs(step) - penalty / bound, 0)
            step0 = look0 - g0 / bound
            d, d0 = step - look, step0 - look0
            if loss(margin(step, step0)) <= at + g @ d + g0 * d0 + bound / 2 * (d @ d + d0 * d0) + 1e-12 or bound > 1e6:
                break
            bound *= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look0 = step + (t - 1) / t_next * (step - w), step0 + (t - 1) / t_next * (step0 - start)
        moved = np.abs(step - w).max(initial=0)
        w, start, t, bound = step, step0, t_next, bound * 0.95
        if moved < 1e-4:
            break
    words[pick] = w[:k]
    return Linear(words, w[k:], float(start))


class ToxicityChain:
    """Fitted models, in the order of their categories."""

    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityChain:
        """``categories`` maps each category to a 0/1 expression over ``labels``, in the order of the chain."""
        ship(docs.sparkSession)
        ys = [f"y{k}" for k in range(len(categories))]
        lab = labels.select(F.col(id_col).alias("id"), *[e.cast("double").alias(y) for y, e in zip(ys, categories.values(), strict=True)]).dropna().dropDuplicates(["id"])
        share = min(1.0, sample / max(lab.count(), 1))
        some = lab.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * share))
        own = private(docs, {"id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
        rows = own.join(F.broadcast(some), "id")  # at most about ``sample`` rows
        schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("words", T.BinaryType())])
        table = rows.mapInArrow(lean(_featured), schema)
        got = table.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS))).orderBy("id").toPandas()
        words = [np.frombuffer(x, "<i4") for x in got["words"]]
        fold, before = got["fold"].to_numpy(), np.zeros((len(got), 0))
        models = []
        for k, y in enumerate(ys):
            truth = got[y].to_numpy(float)
            models.append(fit_linear(words, before, truth))
            if k + 1 < len(ys):
                p = np.zeros(len(got))
                for f in range(FOLDS):
                    rest, own_rows = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    p[own_rows] = fit_linear([words[i] for i in rest], before[rest], truth[rest])([words[i] for i in own_rows], before[own_rows])
                before = np.column_stack([before, p])
        return cls(list(categories), models)

    def _scorer(self, text_col: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(word_places(as_bytes(batch.column(text_col))))
                before = np.zeros((len(rows), 0))
                for name, model in zip(self.categories, self.models, strict=True):
                    p = model(rows, before)
                    batch = batch.append_column(f"p_{name}", pa.array(p))
                    before = np.column_stack([before, p])
                yield batch

        return run

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
        """doc_id and p_<category> for every row of ``docs``; with ``keep`` its columns and p_<category>."""
        ship(docs.sparkSession)
        df = docs if keep else private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
        schema = T.StructType([*df.schema.fields, *[T.StructField(f"p_{c}", T.DoubleType()) for c in self.categories]])
        out = df.mapInArrow(lean(self._scorer(text_col if keep else "text")), schema)
        return out if keep else out.drop("text")


def standard_chain(docs: DataFrame, labels: DataFrame) -> ToxicityChain:
    """The chain for the ``labels`` table: poor quality first, then toxic."""
    return ToxicityChain.fit(docs, labels, {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")})
