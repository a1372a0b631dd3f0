"""Units of a conversation ranked for questions: shared keywords, topics and summaries, less with age.

Units and questions meet on the words they share, never pair by pair.  A word
counts once for each of a unit's three lists that holds it; null lists are
empty.  A question without words gets the newest units, without a score (these
are ``top`` rows, so they are broadcast).  Equal scores go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.search import ranked

#: Weights of the lists, the loss a day and the least that is left (fixed values).
WEIGHTS, DAILY, LEAST = {"keywords": 1.0, "topic": 2.0, "summary": 1.5}, 0.1, 0.5


def _weighed(words: str, weight: float) -> Column:
    distinct = F.array_distinct(F.coalesce(F.col(words), F.array().cast("array<string>")))
    return F.transform(distinct, lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))


def relevant(units: DataFrame, questions: DataFrame, top: int) -> DataFrame:
    """(query, id, score, rank) of units (id, keywords, topic, summary, days) for questions (query, words)."""
    lists = [_weighed(k, x) for k, x in WEIGHTS.items()]
    held = units.select("id", "days", F.concat(*lists).alias("w")).select("id", "days", F.explode("w").alias("w"))
    held = held.groupBy("id", "days", F.col("w.word").alias("word")).agg(F.sum("w.weight").alias("weight"))
    asked = questions.select("query", F.explode(F.array_distinct("words")).alias("word"))
    fresh = F.greatest(F.lit(LEAST), 1 - DAILY * F.coalesce("days", F.lit(0)))
    scores = held.join(asked, "word").groupBy("query", "id", "days").agg(F.sum("weight").alias("sum")).select("query", "id", F.round(F.col("sum") * fresh, 6).alias("score"))
    newest = units.select("id", "days").orderBy(F.asc_nulls_last("days"), "id").limit(top)
    newest = newest.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("days", F.lit(2147483647)).alias("days"), "id"))).alias("x"))
    without = questions.where("words is null or size(words) = 0").select("query").join(F.broadcast(newest)).select("query", F.posexplode("x").alias("n", "x"))
    without = without.select("query", F.col("x.id").alias("id"), F.lit(None).cast("double").alias("score"), (F.col("n") + 1).cast("long").alias("rank"))
    return ranked(scores, top).unionByName(without)
