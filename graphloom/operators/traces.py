"""Traces (arrays of nodes) inside others: as a stretch, or in order with gaps.

Stretches: each trace's windows of the lengths that shorter traces have are a
table, reduced to its distinct rows; a trace that equals one of them is part of a
longer one.  No node brings traces together, however popular it is.  A trace of n
nodes has at most n * n / 2 windows, so this is for traces of bounded depth.

Gaps: an asked sequence meets the paths through its rarest node alone, and only
those candidates are followed node by node.

Nodes compare as trimmed text, null as the empty text.  Null arrays take no part;
an empty trace is part of any other; an empty sequence is held by every path and
gives no rows.  Repeated traces count once, repeated ids give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut


def normal(path: Column) -> Column:
    """A path's nodes as trimmed text."""
    return F.transform(path.cast("array<string>"), lambda x: F.trim(F.coalesce(x, F.lit(""))))


def longest(traces: DataFrame) -> DataFrame:
    """The different traces (path) that are no stretch of a longer one."""
    every = cut(traces.where("path is not null").select("path", normal(F.col("path")).alias("nodes")).groupBy("nodes").agg(F.min("path").alias("path")), "traces")
    sizes = every.agg(F.collect_set(F.size("nodes"))).first()[0]  # as many as traces have lengths
    shorter = F.filter(F.array(*map(F.lit, sorted(sizes))) if sizes else F.array().cast("array<int>"), lambda n: n < F.size("nodes"))
    at = every.select("nodes", F.explode(shorter).alias("n"))
    windows = at.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - F.col("n") + 1), lambda i: F.slice("nodes", i, F.col("n")))).alias("nodes"))
    return every.join(windows.distinct(), "nodes", "left_anti").select("path")


def follows(path: Column, asked: Column) -> Column:
    """Whether ``path`` has the nodes of ``asked`` in order, others between them or not."""
    return F.aggregate(path, F.lit(0), lambda done, x: done + F.when((done < F.size(asked)) & (F.get(asked, done) == x), 1).otherwise(0)) == F.size(asked)


def subsequences(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(ask, id) of asked sequences (ask, nodes) and the paths (id, path) that have them in order."""
    asks = asked.where("size(nodes) > 0").select("ask", normal(F.col("nodes")).alias("nodes"))
    have = cut(paths.where("path is not null").select(F.monotonically_increasing_id().alias("row"), "id", normal(F.col("path")).alias("path")), "paths")
    asks = cut(asks.select(F.monotonically_increasing_id().alias("asked"), "ask", "nodes"), "asked")
    place = have.select("row", F.explode(F.array_distinct("path")).alias("node"))
    wanted = asks.select("asked", F.explode(F.array_distinct("nodes")).alias("node"))
    common = place.groupBy("node").agg(F.count("*").alias("n"))
    rare = wanted.join(common, "node", "left").fillna(0, ["n"]).groupBy("asked").agg(F.min(F.struct("n", "node")).alias("x"))
    met = rare.where("x.n > 0").select("asked", F.col("x.node").alias("node")).join(place, "node").select("asked", "row")
    return met.join(asks, "asked").join(have, "row").where(follows(F.col("path"), F.col("nodes"))).select("ask", "id")
