"""Quality rules: lines that many documents of one host share are boilerplate.

Each document's lines are normalised (A-Z lower-cased, runs of white space one
space, ends trimmed) and hashed; per host the distinct documents of each line
are counted.  A line in more documents than the limit is taken out, and a
document that loses too much is rejected, as are those that fail the base
rules (too few words, too much of the text in repeated 5-word windows).

Defined results: a null text has no words and fails the base rules; a null
host is a host of its own; rows with one id count as one document in a line's
count, rows without an id as one more; repeated rows each get their result;
an empty table gives an empty result; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import lean, private, saved, ship
from graphloom.llm.textkernel import SPACE, SYMBOL, Words, as_bytes, chunks

#: A line goes when more documents of its host have it, however large the host is.
MIN_DOCS = 20
#: A document stays with so many words left, and so much of its words.
MIN_WORDS, MIN_LEFT = 10, 0.3
#: Copies of the table of frequent lines, over which a very common line's rows are dealt.
SALTS = 32

_FACTS = "doc_id string, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _lines(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words in each distinct normalised line."""
    seen, twice, out = set(), 0, {}
    for line in text.split(b"\n"):
        words = len(line.split())
        if words:
            twice += line in seen
            seen.add(line)
            h = line_hash(normalised(line))
            out[h] = out.get(h, 0) + words
    return twice, out


def _repeated(windows: np.ndarray) -> int:
    """Words in windows that occur at least twice."""
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    mark = np.zeros(len(windows) + 5, np.int32)
    mark[: len(windows)] += hit
    mark[5:] -= hit
    return int((np.cumsum(mark) > 0).sum())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for at, run in chunks(texts):
            w = Words(run, fold=False)
            win = w.windows()
            n_words = np.diff(w.first)
            at0 = w.text_at[:-1]
            in_word = (SPACE[w.blob] == 0) & ((w.blob & 0xC0) != 0x80)
            chars = np.add.reduceat(in_word.astype(np.int64), at0)
            symbols = np.add.reduceat(SYMBOL[w.blob], at0)
            repeat = [_repeated(win[a : b - 4]) if b - a > 5 else 0 for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            twice, lines = zip(*map(_lines, run), strict=True)
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array([k for x in lines for k in x], pa.int64()), pa.array([v for x in lines for v in x.values()], pa.int64())], names=["line", "words"])
            part = batch.slice(at, len(run))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), pa.array(n_words, pa.int64()), pa.array(chars), pa.array(symbols), pa.array(twice, pa.int64()), pa.array(repeat, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), flat)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def _frequent(facts: DataFrame, min_docs: int) -> DataFrame:
    """(host, line) in more documents of the host than the limit; hosts and ids with "" for null."""
    lines = facts.select("host", "doc_id", F.explode("lines.line").alias("line"))
    return lines.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n_docs")).where(F.col("n_docs") > min_docs)


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT
) -> tuple[DataFrame, DataFrame]:
    """Per row its base figures and verdict, and the table of lines to take out.

    The first table has doc_id (of the input's type), host, the base figures,
    removed_words, base_failed and kept; the second host, line (hash) and
    n_docs, for :func:`without_lines`.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes).get(id_col, "string")
    own = private(docs, {"doc_id": id_col, "text": text_col, "host": host_col}).select(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.col("host").cast("string")).alias("host"), F.col("text").cast("string"))
    facts = own.mapInArrow(lean(_facts), _FACTS).withColumns({"row": F.monotonically_increasing_id(), "host": F.coalesce("host", F.lit("")), "null_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(""))})
    facts = saved(facts, "line-facts")
    frequent = saved(_frequent(facts, min_docs), "frequent-lines")
    salted = _salted(frequent)
    rows = facts.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = rows.join(salted, ["host", "line", "salt"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = facts.drop("lines").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "kept": ~failed & (left >= min_words) & (left >= F.col("n_words") * min_left)})
    doc_id = F.when(~F.col("null_id"), F.col("doc_id")).cast(kind).alias("doc_id")
    host = F.when(F.col("host") != "", F.expr("substring(host, 2)")).alias("host")
    return out.select(doc_id, host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"), frequent


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(as_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            drop = set(gone or ())
            out.append(text if text is None or not drop else b"\n".join(x for x in text.split(b"\n") if line_hash(normalised(x)) not in drop))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "text"])


def _salted(frequent: DataFrame) -> DataFrame:
    return frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [list(_lines(t or b"")[1]) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(lines, pa.list_(pa.int64()))], names=["row", "host", "lines"])


def without_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the lines of ``frequent`` (of :func:`line_frequency`) taken out of the text; other columns stay.

    Documents meet the lines one by one, so a host may have any number of them;
    a document only gets those that it has.
    """
    ship(docs.sparkSession)
    names = docs.columns
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host")
    own = rows.select(F.col("_row").alias("row"), host, F.col(text_col).cast("string").alias("text"))
    lines = own.mapInArrow(_line_hashes, "row long, host string, lines array<long>").select("row", "host", F.explode("lines").alias("line"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = lines.join(_salted(frequent), ["host", "line", "salt"]).groupBy("row").agg(F.collect_list("line").alias("gone"))
    text = own.select("row", "text").join(gone, "row", "left").mapInArrow(_strip, "row long, text string")
    back = rows.drop(text_col).join(text.select(F.col("row").alias("_row"), F.col("text").alias(text_col)), "_row")
    return back.select(*names)
