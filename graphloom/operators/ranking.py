"""Ranking patterns: caps per group, one per group first, dynamic k, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def capped(rows: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of a group, in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def diversified(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each group first, then by global order, up to k; ``pick`` is the place."""
    ranked = rows.withColumn("_in", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    first = F.when(F.col("_in") == 1, 0).otherwise(1)
    picked = ranked.select("*", first.alias("_first")).orderBy("_first", *order).limit(k)
    return picked.withColumn("pick", F.row_number().over(W.orderBy("_first", *order))).drop("_in", "_first")


def dynamic_k(rows: DataFrame, score: str, order: list[Column], ratio: float, least: int, most: int) -> DataFrame:
    """Rows in the band of scores at ``ratio`` of the best, clamped to least..most rows."""
    best = rows.agg(F.max(score).alias("_best"))
    band = rows.join(F.broadcast(best)).where(F.col(score) >= F.col("_best") * ratio).agg(F.count("*").alias("_k"))
    top = rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return top.join(F.broadcast(band)).where(F.col("rank") <= F.greatest(F.lit(least), F.least(F.lit(most), F.col("_k")))).drop("_k")


def round_robin(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One of each group in turn until n."""
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("turn", group).limit(n)


def last_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return capped(rows, group, order, k)
