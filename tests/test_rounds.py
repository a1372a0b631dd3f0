"""Rounds on graphs: what they write and how their work is dealt out."""

from pyspark.sql import functions as F

from graphloom.operators import communities as C
from graphloom.operators import graph as G
from graphloom.operators import matching as M


def test_a_round_writes_a_row_for_each_node(spark):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(a)] + [(20, 20)], "caller long, callee long")
    links, nodes = C._graph(edges)
    made = C._choices(C.dealt(links), nodes.withColumn("label", F.col("node")), 134, [(0, False), (1, True)])
    rows = {r["node"]: r for r in made.collect()}
    assert made.count() == len(rows) == 13 and rows[20]["most"] is None and rows[20]["inner"] == 0
    assert {rows[n]["most"] for n in range(12)} == {134.0 - 11 * 11}
    assert all(r["to0"] is None or r["to0"]["to"] != n for n, r in rows.items())


def test_votes_are_dealt_out(spark, monkeypatch):
    pairs = [(a, (a * 7 + k) % 40) for a in range(40) for k in (1, 2, 5) if a != (a * 7 + k) % 40]
    edges = spark.createDataFrame(pairs, "caller long, callee long")
    once = sorted(map(tuple, G.label_propagation(edges, 3).collect()))
    monkeypatch.setattr(G, "LINKS", 50)
    assert G.dealt(edges.toDF("node", "other")).rdd.getNumPartitions() == 1 + len(pairs) // 50
    assert sorted(map(tuple, G.label_propagation(edges, 3).collect())) == once and len(once) == 40


def test_only_better_documents_are_looked_at(monkeypatch):
    """2,000 documents that all plans touch: of those that end behind a query's last row none is pushed."""
    plans = [(q, k, "primary", w, "open graph", ["open", "graph"], [], []) for q in range(40) for k, w in ((0, 1.0), (1, 0.78))]
    pushed = []
    real = M.heapq.heapreplace
    monkeypatch.setattr(M.heapq, "heapreplace", lambda h, row: pushed.append(row) or real(h, row))
    monkeypatch.setattr(M, "round", lambda *a: pushed.append(a) or round(*a), raising=False)
    batch = M.pa.RecordBatch.from_pydict({"id": list(range(2000)), "path": ["a/b"] * 2000, "text": ["open the graph"] * 2000})
    (got,) = M._best(plans, 3)(iter([batch]))
    assert sorted(zip(got["query"].to_pylist(), got["id"].to_pylist(), got["plan"].to_pylist())) == [(q, i, 0) for q in range(40) for i in range(3)]
    assert set(got["score"].to_pylist()) == {2.2} and len(pushed) < 2000
