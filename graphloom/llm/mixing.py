"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 1, 2, 3 and again from 1.  They
share all words by weight; no target exceeds three times what its source has,
and what is cut there goes to the others by weight.  A source is taken whole
as often as its target allows.  For the budget that remains, documents are
counted by exact length; every length gives its share of the budget, and a
bounded-knapsack dynamic programme over the lengths left fills what is left of
it as closely as can be.  Of each length as many documents as were chosen go
into the mix, in the order of a seeded hash.

Spark sees documents only as (source, size, hash): lengths are counted with
map-side sums, a source's programme runs over its distinct lengths (their
number grows with the square root of the source at most), and the documents of
a length are cut by hash buckets, so no task ever holds a source.

Defined results: null texts have size 0, are taken 0 words and come along in
every whole round; null sources are one source; repeated rows are documents of
their own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.cluster import private, saved, ship

#: Most repeats of a document; documents in a hash bucket (about); words that the programme fills at most.
REPEATS, BUCKET, BUDGET = 3, 4096, 1 << 17
SEED = 17


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their weights: ranks by range partitions, so no task sorts them all."""
    rows = saved(sources.repartitionByRange(8, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts = np.cumsum([0, *[n for _, n in sizes]])
    before = sources.sparkSession.createDataFrame([(p, int(x)) for (p, _), x in zip(sizes, starts[:-1], strict=True)], "part int, before long")
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    return rows.join(F.broadcast(before), "part").withColumn("weight", (rank % 3 + 1).cast("double")).drop("part", "before")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with weight and target; the share per weight rises until no source is above its cap."""
    rows = saved(_ranked(sources).withColumn("cap", F.col("source_size") * float(REPEATS)), "weights")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        r = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("done"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        if not r["w"] or r["n"] == capped:
            break
        level, capped = (total - r["done"]) / r["w"], r["n"]
    return rows.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap")


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum is as near ``budget`` as can be, from below or above.

    Every size gives its share; the programme then chooses among what is left.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take[:] = [int(c) * budget // total for c in counts]
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:  # bring the rest into the programme's reach: about one more of each size, large ones first
        if left <= BUDGET // 2:
            break
        if sizes[i] and sizes[i] <= left:
            k = min(int(counts[i] - take[i]), max(1, (left - BUDGET // 2) // int(sizes[i]) // 2) if left > BUDGET else 1)
            take[i] += k
            left -= k * int(sizes[i])
    most = min(left, BUDGET)
    reach, first = 1, np.full(most + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    mask = (1 << (most + 1)) - 1
    for i in order:
        size, spare, unit = int(sizes[i]), int(counts[i] - take[i]), 1
        if not size or size > most:
            continue
        spare = min(spare, most // size)
        while spare > 0 and not reach >> most & 1:
            k = min(unit, spare)
            new = (reach << k * size) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((most >> 3) + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[: most + 1])] = len(items)
                items.append((int(i), k))
                reach |= new
            spare, unit = spare - k, unit * 2
        if reach >> most & 1:
            break
    s = reach.bit_length() - 1
    while s:
        i, k = items[first[s]]
        take[i] += k
        s -= k * int(sizes[i])
    rest = budget - int((sizes * take).sum())
    spare = np.flatnonzero((counts > take) & (sizes > 0))
    if rest > 0 and len(spare):  # one document more if that comes nearer
        i = spare[np.argmin(np.abs(sizes[spare] - rest))]
        take[i] += abs(int(sizes[i]) - rest) < rest
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    have, target = int((sizes * counts).sum()), float(pdf["target"].iloc[0])
    whole = min(int(target // have), REPEATS) if have else 0
    take = fill(sizes, counts, round(target - whole * have)) if whole < REPEATS else np.zeros(len(sizes), np.int64)
    return pd.DataFrame({"source": pdf["source"], "size": sizes, "whole": whole, "take": take})


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: _row, doc_id, source, size, source_size, target and copies (how often the mix takes it).

    ``_row`` numbers the rows as one reading of ``docs`` lists them.
    """
    kind = dict(docs.dtypes).get(id_col, "string")
    own = private(docs, {"doc_id": id_col, "text": text_col, "source": source_col})
    own = own.select("doc_id", F.col("source").cast("string"), _size("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = saved(own, "sizes").withColumn("source", F.concat(F.lit("="), "source"))
    return _planned(rows, kind)


def _planned(rows: DataFrame, kind: str) -> DataFrame:
    key = F.coalesce("source", F.lit(""))
    rows = rows.withColumn("source", key)
    counts = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = saved(targets(per.withColumn("source", F.when(F.col("source") != "", F.col("source")))).withColumn("source", key), "targets")
    lengths = counts.join(goal.select("source", "target"), "source")
    plan = lengths.groupBy("source").applyInPandas(_plan, "source string, size long, whole long, take long")
    plan = plan.join(counts, ["source", "size"]).withColumn("buckets", F.greatest(F.lit(1), (F.col("n") / BUCKET).cast("long")))
    plan = saved(plan.join(goal.select("source", "source_size", "target"), "source"), "plan")
    inner = rows.join(plan, ["source", "size"]).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 1), F.col("buckets")))
    sure = F.col("take") == F.col("n")
    split = (F.col("take") > 0) & ~sure
    filled = inner.where(split).groupBy("source", "size", "bucket").agg(F.count("*").alias("m"), F.first("take").alias("take"))
    before = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cut = filled.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).select("source", "size", "bucket", (F.col("take") - F.col("before")).alias("quota"))
    place = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    some = inner.where(split).join(cut, ["source", "size", "bucket"]).withColumn("extra", (place <= F.col("quota")).cast("int")).drop("quota")
    rest = inner.where(~split).withColumn("extra", sure.cast("int") * (F.col("take") > 0).cast("int"))
    out = rest.unionByName(some).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return out.withColumn("source", F.when(F.col("source") != "", F.expr("substring(source, 2)")))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target and taken (words, repeats counted)."""
    ship(docs.sparkSession)
    plan = mix_plan(docs, id_col, text_col, source_col, seed)
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes).get(id_col, "string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    plan = _planned(saved(rows, "sizes").withColumn("source", F.concat(F.lit("="), "source")), kind)
    # Rows of one id, text and source are the same; how often they are taken together is what counts.
    share = plan.groupBy(F.col("h").alias("_h"), F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    wanted = saved(share.where(F.col("_copies") > 0), "taken")
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    found = docs.join(wanted, (h == wanted["_h"]) & F.col(id_col).eqNullSafe(wanted["_id"]))
    one = F.row_number().over(W.partitionBy("_id", "_h").orderBy(F.lit(0)))
    even = F.floor(F.col("_copies") / F.col("_rows")).cast("int")
    if wanted.where("_rows > 1").limit(1).count():
        copies = even + (one <= F.col("_copies") % F.col("_rows")).cast("int")
        found = found.withColumn("_n", copies)
    else:
        found = found.withColumn("_n", even)
    return found.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
