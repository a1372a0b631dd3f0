"""Strongly connected components, and cycles of a bounded length inside them.

Components are found round by round.  Nodes without an edge in or out are
trimmed.  Of what is left every node takes the node of the smallest hash that
reaches it (its colour, forward); a node that has its own colour is a root, and
what reaches a root backwards through its colour is the root's component.
Edges between colours are on no cycle and go with the components.  Hashes deal
the colours out, so a chain of components takes few rounds.

Cycles start at their smallest node and grow edge by edge over larger nodes of
the same component, so each is found once, in its smallest rotation.  A path
goes on only while the way back to its start is short enough: distances to the
start are counted backwards first, over the same nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut


#: Steps of a loop that one job takes.
STRIDE = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both in and out."""
    n = edges.count()
    while True:
        for _ in range(STRIDE):
            both = edges.select(F.col("caller").alias("node")).join(edges.select(F.col("callee").alias("node")), "node", "left_semi").distinct()
            edges = edges.join(both.toDF("caller"), "caller", "left_semi").join(both.toDF("callee"), "callee", "left_semi").select("caller", "callee")
        edges = cut(edges, "trimmed")
        left = edges.count()
        if left == n:
            return edges
        n = left


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(node, colour): the smallest colour of a node that reaches a node along edges, its own included."""
    while True:
        step = label.withColumn("was", F.col("colour"))
        for _ in range(STRIDE):
            come = edges.join(step.select(F.col("node").alias("caller"), F.col("colour").alias("come")), "caller").groupBy(F.col("callee").alias("node")).agg(F.min("come").alias("come"))
            step = step.join(come, "node", "left").select("node", F.least("colour", F.coalesce("come", "colour")).alias("colour"), "was")
        step = cut(step, "colours")
        label = step.select("node", "colour")
        if step.where("colour <> was").isEmpty():
            return label


def _backwards(inside: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, colour): what reaches a root (node, colour) over edges (caller, callee, a) of its colour."""
    found = front = roots
    while True:
        level, reach = front, None
        for _ in range(STRIDE):
            level = level.join(inside, (F.col("node") == F.col("callee")) & (F.col("colour") == F.col("a"))).select(F.col("caller").alias("node"), "colour").distinct()
            reach = level if reach is None else reach.unionByName(level)
        front = cut(reach.distinct().join(found, ["node", "colour"], "left_anti"), "reached")
        if front.isEmpty():
            return cut(found, "found")
        found = found.unionByName(front)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in strongly connected components of two nodes or more; ``comp`` is the smallest node."""
    rest = cut(edges.where("caller is not null and callee is not null and caller <> callee").select("caller", "callee").distinct(), "edges")
    out = rest.select(F.col("caller").alias("node"), F.col("caller").alias("comp")).limit(0)
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            return out
        nodes = rest.select(F.col("caller").alias("node")).distinct()
        colour = _spread(rest, nodes.withColumn("colour", F.struct(F.xxhash64("node").alias("h"), "node")))
        inside = rest.join(colour.toDF("caller", "a"), "caller").join(colour.toDF("callee", "b"), "callee").where("a = b").select("caller", "callee", "a")
        inside = cut(inside, "inside")
        found = _backwards(inside, cut(colour.where("node = colour.node"), "roots"))
        named = found.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("comp")).where("n > 1")
        out = cut(out.unionByName(found.join(named, "colour").select("node", "comp")), "components")
        done = found.select("node")
        rest = cut(inside.join(done.toDF("caller"), "caller", "left_anti").join(done.toDF("callee"), "callee", "left_anti").select("caller", "callee"), "edges")


def _short(edges: DataFrame, most: int) -> DataFrame:
    """(path): cycles of two and of three nodes.

    Each lies between an edge from its smallest node and one back to it, so two
    joins find them; components would only cost more passes.
    """
    out, back = edges.where("caller < callee").select(F.col("caller").alias("start"), F.col("callee").alias("a")), edges.where("caller > callee").select(F.col("callee").alias("start"), F.col("caller").alias("last"))
    paths = out.join(back, (out["start"] == back["start"]) & (F.col("a") == F.col("last"))).select(F.array(out["start"], "a").alias("path")) if most > 1 else edges.select(F.array("caller").alias("path")).limit(0)
    if most < 3:
        return paths
    # the middle edge is looked up among all edges by both its ends
    pairs = out.join(back, "start").where("a <> last")
    three = pairs.join(edges, (F.col("a") == F.col("caller")) & (F.col("last") == F.col("callee"))).select(F.array("start", "a", "last").alias("path"))
    return paths.unionByName(three)


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """(path): the cycles of two to ``most`` nodes, each once, from its smallest node; loops are cycles of one."""
    e = edges.where("caller is not null and callee is not null").select("caller", "callee").distinct()
    loops = e.where("caller = callee").select(F.array("caller").alias("path"))
    if most <= 3:
        return loops.unionByName(_short(cut(e.where("caller <> callee"), "edges"), most))
    comp = strong_components(edges)
    inner = e.where("caller <> callee").join(comp.toDF("caller", "a"), "caller").join(comp.toDF("callee", "b"), "callee").where("a = b").select("caller", "callee")
    inner = cut(inner, "inner")
    # (node, start, back): steps from a node back to a smaller start over nodes above it
    back = cut(inner.where("caller > callee").select(F.col("caller").alias("node"), F.col("callee").alias("start"), F.lit(1).alias("back")), "back")
    front = back
    for k in range(2, most):
        step = front.join(inner, front["node"] == inner["callee"]).where("caller > start").select(F.col("caller").alias("node"), "start").distinct()
        front = cut(step.join(back.select("node", "start"), ["node", "start"], "left_anti").withColumn("back", F.lit(k)), "back")
        if front.isEmpty():
            break
        back = back.unionByName(front)
    out = loops
    way = back.toDF("callee", "start", "back")
    path = inner.where("caller < callee").join(way, "callee").where((F.col("caller") == F.col("start")) & (F.col("back") < most)).select(F.array("start", "callee").alias("path"), "start", F.col("callee").alias("last"), "back")
    for n in range(2, most + 1):
        path = cut(path, "paths")
        if path.isEmpty():
            break
        out = out.unionByName(path.where("back = 1").select("path"))
        if n < most:
            grown = path.select("path", "start", "last").join(inner, F.col("last") == F.col("caller")).where((F.col("callee") > F.col("start")) & ~F.array_contains("path", F.col("callee")))
            path = grown.select("path", "start", "callee").join(way, ["callee", "start"]).where(F.col("back") <= most - n).select(F.concat("path", F.array("callee")).alias("path"), "start", F.col("callee").alias("last"), "back")
    return out
