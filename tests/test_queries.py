"""Every registered query of the library against its SQL twin, and operators on hand fixtures."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import finance, text
from graphloom.operators import graph as G
from graphloom.operators import ranking, search
from graphloom.sources import code, flow, sinks, workbook

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return ("f", round(v, 6) + 0.0)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        assert sorted(repr(tuple(map(norm, r))) for r in duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()) == rows
    else:
        assert rows


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "caller string, callee string")


def test_hand_graphs(spark):
    chain = edges(spark, ("D", "C"), ("C", "A"), ("A", "B"))
    seed = spark.createDataFrame([("D",)], "node string")
    assert {r["node"]: r["depth"] for r in G.bfs_levels(chain, seed).collect()} == {"D": 0, "C": 1, "A": 2, "B": 3}
    assert [r["path"] for r in G.paths(chain, seed, 10).collect()] == [["D", "C", "A", "B"]]
    diamond = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    assert G.paths(diamond, spark.createDataFrame([("a",)], "node string"), 10).count() == 2
    triangle = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert [tuple(r) for r in G.triangles(triangle).collect()] == [("a", "b", "c")]
    two = edges(spark, ("a", "b"), ("b", "c"), ("x", "y"))
    assert {r["node"]: r["comp"] for r in G.components(two).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    none = chain.limit(0)
    assert G.bfs_levels(none, seed).count() == 1 and G.triangles(none).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query int, id string, rank long")
    got = [(r["id"], r["score"]) for r in search.fused([a, b], 10).orderBy("rank").collect()]
    assert [x for x, _ in got] == ["y", "x", "z"] and math.isclose(got[0][1], 1 / 62 + 1 / 61, abs_tol=1e-7)


def test_finance(spark):
    one = spark.range(1)
    r = one.select(finance.future_value(F.lit(1000.0), F.lit(0.05), F.lit(10)).alias("fv"), finance.net_present_value(F.array(*[F.lit(x) for x in (-1000.0, 400.0, 400.0, 400.0)]), F.lit(0.0)).alias("npv"), finance.loan_payment(F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("loan")).first()
    assert round(r["fv"], 2) == 1628.89 and r["npv"] == 200 and r["loan"] == 100
    assert math.isclose(finance.irr([-1000.0, 1500.0]), 0.5, abs_tol=1e-6) and finance.irr([1000.0]) is None


def test_text(spark):
    x = spark.createDataFrame([("getUserName of_the-File", "a/b/c.py")], "t string, p string")
    r = x.select(text.default_tokens(F.col("t")).alias("d"), text.basename(F.col("p")).alias("b"), text.dirname(F.col("p")).alias("f"), text.truncate_word(F.lit("hello brave world"), 12).alias("w"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), text.bigrams(F.lit("abc")).alias("g")).first()
    assert r["d"] == ["get", "user", "name", "file"] and (r["b"], r["f"]) == ("c.py", "a/b") and r["w"] == "hello brave" and math.isclose(r["j"], 1 / 3) and r["g"] == ["ab", "bc"]


def test_ranking(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 4), ("a", 3), ("b", 2)], "g string, s int")
    assert [r["s"] for r in ranking.diversified(rows, "g", [F.desc("s")], 3).orderBy("pick").collect()] == [5, 2, 4]
    assert ranking.capped(rows, "g", [F.desc("s")], 2).count() == 3


def test_code_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text('class A(B):\n    """Doc."""\n    def m(self, x):\n        return helper(x)\n\ndef helper(x):\n    return x\n')
    (tmp_path / "src" / "bad.py").write_text("def (")
    (tmp_path / "node_modules" / "b.py").write_text("x = 1")
    files = code.code_tree(spark, str(tmp_path))
    assert files.count() == 2
    symbols = code.python_symbols(files)
    assert {(r["kind"], r["name"]) for r in symbols.collect()} == {("class", "A"), ("method", "m"), ("call", "helper"), ("function", "helper")}
    assert [tuple(r) for r in code.call_edges(symbols).collect()] == [("A.m", "helper", 0.85)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\r\nyou\x01'), (2, None)], "id int, t string")
    sinks.quoted_csv(df, str(tmp_path / "csv"))
    back = code.csv_table(spark, str(tmp_path / "csv"), "id int, t string")
    assert sorted((r["id"], r["t"]) for r in back.where("id = 1").collect()) == [(1, 'say "hi"\nyou')]
    assert sinks.markdown_table(df.where("id = 2")).endswith("| 2 |  |")


def test_long_chains_and_cycles(spark):
    """Traversals without a bound go to the end: a chain of 130 nodes, and a cycle behind it."""
    chain = spark.range(130).selectExpr("id as caller", "id + 1 as callee").union(spark.createDataFrame([(130, 128)], "caller long, callee long")).cache()
    got = {r["node"]: r["depth"] for r in G.bfs_levels(chain, spark.createDataFrame([(0,)], "node long"), stride=20).collect()}
    assert got == {i: i for i in range(131)}
    assert G.bfs_levels(chain, spark.createDataFrame([(0,)], "node long"), most=5).count() == 6
    up = {(r["child"], r["ancestor"]): r["depth"] for r in G.closure(chain.toDF("child", "parent")).collect()}
    assert up[0, 130] == 130 and up[128, 128] == 3 and (127, 127) not in up and up[130, 129] == 2
    assert len(up) == sum(130 - i for i in range(128)) + 9


def test_local_moves(spark):
    """Two cliques with one edge between them are two communities."""
    cliques = [(a, b) for group in ("abcde", "vwxyz") for a in group for b in group if a < b]
    nodes = {n: i for i, n in enumerate("abcdevwxyz")}
    e = spark.createDataFrame([(nodes[a], nodes[b]) for a, b in [*cliques, ("e", "v")]], "caller long, callee long")
    got = {r["node"]: r["label"] for r in G.local_moves(e, 12).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]
    assert G.local_moves(e.limit(0), 2).count() == 0


def test_flow(spark):
    text = "def f(a, b):\n    while a:\n        c = b\n        a = c\n    else:\n        b = 1\n    if b:\n        raise b\n    return c\n"
    files = spark.createDataFrame([("x.py", text), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    assert {(r["line"], r["next"], r["kind"]) for r in flow.control(files).collect()} == {(2, 3, "true"), (3, 4, "next"), (4, 2, "next"), (2, 6, "false"), (6, 7, "next"), (7, 8, "true"), (7, 9, "false")}
    assert {(r["name"], r["line"], r["used"]) for r in flow.data(files).collect()} == {("a", 1, 2), ("b", 1, 3), ("c", 3, 4), ("b", 6, 7), ("b", 6, 8), ("c", 3, 9)}
    kinds = {(r["kind"], r["name"]) for r in flow.statements(files).collect()}
    assert {("param", "a"), ("def", "c"), ("use", "b"), ("return", "")} <= kinds


def test_workbook(spark):
    rows = spark.createDataFrame([("1", 1, "why\x01 <&>?", "so\r\nbe it"), ("1", 2, None, None), ("1", 3, " ", "x")], "s string, k int, question string, answer string")
    got = [tuple(r) for r in workbook.questions(workbook.written(rows, "s", "k", ["question", "answer"])).collect()]
    assert got == [("1", 2, "why <&>?", "so\r\nbe it"), ("1", 4, " ", "x")]
