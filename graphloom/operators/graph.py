"""Graph operators on edge tables (caller, callee): traversal, cycles, motifs, communities, scores.

Unbounded traversals are frontier loops: a level joins the edges, drops what
was seen and is written out, so a level's cost is its frontier's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.lineage import cut


def bfs_levels(edges: DataFrame, seeds: DataFrame, most: int | None = None, stride: int = 3) -> DataFrame:
    """(node, depth): the least number of edges from any seed (a column ``node``), up to ``most`` if that is given.

    A job takes ``stride`` levels at a time, which long chains need and dense graphs do not mind.
    """
    seen = cut(seeds.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    front, depth = seen.select("node"), 0
    while most is None or depth < most:
        levels = stride if most is None else min(stride, most - depth)
        reach = None
        for k in range(1, levels + 1):
            front = front.join(edges, front["node"] == edges["caller"]).select(F.col("callee").alias("node")).distinct()
            level = front.withColumn("depth", F.lit(depth + k))
            reach = level if reach is None else reach.union(level)
        new = cut(reach.groupBy("node").agg(F.min("depth").alias("depth")).join(seen.select("node"), "node", "left_anti"), "bfs")
        depth += levels
        front = new.where(F.col("depth") == depth).select("node")
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(child, ancestor, depth): the least number of steps up (child, parent); nodes of cycles are their own ancestors.

    Each round doubles the steps that are known, so long chains take few rounds.
    """
    out = cut(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    span = 1
    while most is None or span < most:
        far = out.where(F.col("depth") == span).select("child", F.col("ancestor").alias("mid"))
        up = out.select(F.col("child").alias("mid"), "ancestor", "depth")
        step = far.join(up, "mid").groupBy("child", "ancestor").agg((F.min("depth") + span).alias("depth"))
        step = cut(step.join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti"), "closure")
        if not step.limit(1).count():
            break
        out = out.unionByName(step)
        span *= 2
    return out if most is None else out.where(F.col("depth") <= most)


def paths(edges: DataFrame, seeds: DataFrame, most: int, every: bool = False) -> DataFrame:
    """(path) simple paths of at most ``most`` nodes from the seeds, as far as they go; with ``every`` each prefix too."""
    level = cut(seeds.select(F.array("node").alias("path")).distinct(), "paths")
    done: list[DataFrame] = [level] if every else []
    for _ in range(most - 1):
        grown = level.join(edges, F.element_at("path", -1) == edges["caller"]).where(~F.array_contains("path", F.col("callee")))
        grown = cut(grown.select(F.concat("path", F.array("callee")).alias("path"), "path", F.size("path").alias("n")).toDF("path", "was", "n"), "paths")
        if not every:
            done.append(level.join(grown.select("was").distinct(), level["path"] == F.col("was"), "left_anti"))
        level = grown.select("path")
        if not level.limit(1).count():
            break
        if every:
            done.append(level)
    else:
        if not every:
            done.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def triangles(edges: DataFrame) -> DataFrame:
    """Directed cycles of three, each once, from its smallest node."""
    ab = edges.where("caller < callee").toDF("a", "b")
    bc = edges.toDF("b", "c")
    ca = edges.toDF("c", "a")
    return ab.join(bc, "b").where("c > a").join(ca, ["c", "a"]).select("a", "b", "c")


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that call each other."""
    return edges.where("caller < callee").join(edges.toDF("callee", "caller"), ["caller", "callee"]).select(F.col("caller").alias("a"), F.col("callee").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that undirected edges reach."""
    both = cut(edges.union(edges.select("callee", "caller")).toDF("node", "other").distinct(), "links")
    label = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(label.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = cut(label.join(near, "node").select("node", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")), "labels")
        if not step.where("moved").limit(1).count():
            return step.select("node", "comp")
        hop = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        label = cut(step.join(hop, "comp", "left").select("node", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")


#: Links in a part.
LINKS = 1 << 19


def dealt(links: DataFrame) -> DataFrame:
    """Links (node, other, ...) in parts by their far end, about ``LINKS`` each, for all rounds of a loop."""
    return links.repartition(1 + links.count() // LINKS, "other").sortWithinPartitions("other")


def parts_of(links: DataFrame) -> int:
    """How many parts dealt links have; one where there are none, which Spark plans with no part at all."""
    return max(1, links.rdd.getNumPartitions())


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after synchronous rounds: a node takes its neighbours' commonest label, of ties the smallest.

    Votes are dealt out by node in as many parts as the links have, so a task's share does not grow with them.
    """
    both = dealt(cut(edges.union(edges.select("callee", "caller")).toDF("node", "other").distinct(), "links")).persist()
    parts = parts_of(both)
    label = both.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label.toDF("other", "label"), "other").repartition(parts, "node").groupBy("node", "label").agg(F.count("*").alias("n"))
        label = cut(votes.groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")), "labels")
    both.unpersist()
    return label


def local_moves(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): a node goes to the neighbouring community with the most gain in modularity.

    Half of the nodes, by a hash of node and round, move in a round, so that
    neighbours seldom swap places; of equal gains the smallest community is taken.
    """
    both = cut(edges.union(edges.select("callee", "caller")).toDF("node", "other").where("node <> other").distinct(), "links")
    degree = cut(both.groupBy("node").agg(F.count("*").alias("d")), "degrees")
    total = both.count()
    label = degree.select("node", "d", F.col("node").alias("label"))
    for k in range(rounds):
        size = label.groupBy("label").agg(F.sum("d").alias("s"))
        links = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.count("*").alias("k"))
        choice = links.join(size, "label").join(label.select("node", "d", F.col("label").alias("own")), "node")
        rest = F.col("s") - F.when(F.col("label") == F.col("own"), F.col("d")).otherwise(0)
        best = choice.groupBy("node").agg(F.max(F.struct((F.col("k") * total - rest * F.col("d")).alias("gain"), -F.col("label"))).alias("x"))
        moves = best.select("node", (-F.col("x")["col2"]).alias("to"), F.col("x.gain").alias("gain")).where((F.col("gain") > 0) & (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0))
        label = cut(label.join(moves, "node", "left").select("node", "d", F.coalesce("to", "label").alias("label")), "labels")
    return label.select("node", "label")


def tiers(value: Column, steps: list[tuple[float, float]], other: float) -> Column:
    """The score of the first threshold that ``value`` reaches."""
    out = F.lit(other)
    for least, score in reversed(steps):
        out = F.when(value >= least, F.lit(score)).otherwise(out)
    return out


def traces(edges: DataFrame, seeds: DataFrame, most: int, branching: int) -> DataFrame:
    """Paths that follow at most ``branching`` callees of a node, the smallest first."""
    few = edges.withColumn("n", F.row_number().over(W.partitionBy("caller").orderBy("callee"))).where(F.col("n") <= branching).drop("n")
    return paths(cut(few, "few"), seeds, most)
