"""What a review found: queries on tables that the fixtures do not show."""

import math
from datetime import datetime, timedelta

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import cycles as Y
from graphloom.sources import bindings as B
from graphloom.sources import code
from graphloom.streaming import state

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def both(spark, path, name, tables):
    """Rows of a query and of its SQL over ``tables`` (name to a DataFrame), each written as a folder of files."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(path))
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.select(*cols).collect()))), sorted(map(repr, want))


def talk(spark, n=40):
    rows = [(i // 8, i % 8, "assistant" if i % 8 in (3, 6) else "user", f"turn {i} " + "x" * 900) for i in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    for name in ("st_compaction", "st_pending_question"):
        got, want = both(spark, tmp_path / name, name, {"conversations": talk(spark)})
        assert got == want and want


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    rows = spark.createDataFrame([(1, [-1e-7, 1.0, 0.0]), (2, [3.0, -4.0, 1e-7])], "vec_id long, embedding array<float>")
    got, want = both(spark, tmp_path, "s_encode", {"embeddings": rows})
    assert [g.replace("Row", "") for g in got] == want
    assert math.copysign(1, QUERIES["s_encode"](spark, str(tmp_path)).where("vec_id = 1").first()["unit"][0]) == -1


def test_asked_parts_meet_classes_of_parts(spark, tmp_path):
    """60,000 parts of one name: by rows these were 180 million pairs."""
    many = spark.range(60_000).selectExpr("id as p_partkey", "'hot bolt' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "7 as p_size")
    many.write.parquet(f"{tmp_path}/part.parquet")
    want = {(a, i) for a in range(0, 60_000, 20) for i in [x for x in range(5) if x != a][:4]}
    for name in ("s_skill_v1", "s_skill_v2", "s_skill_semantic", "q_skill_refs"):
        assert {(r["ask"], r["id"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert QUERIES["join_seed_nodes"](spark, str(tmp_path)).where("hits = 2 and node <= 6").count() == 18_000


def test_classes_equal_sql_with_nulls_and_odd_names(spark, tmp_path):
    names, brands = ["hot bolt", "bolt hot", "hot", "", " hot", None, "red ring", "hot hot ring"], ["A", "B", None]
    rows = [(i, names[i * 7 % 8], brands[i % 3], ["S", None, "L"][i % 5 % 3], i % 4 if i % 11 else None) for i in range(160)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    for name in ("s_skill_v1", "s_skill_v2", "s_skill_semantic", "q_skill_refs", "join_seed_nodes"):
        got, want = both(spark, tmp_path / name, name, {"part": parts})
        assert got == want and want


def test_modules_and_archives_are_dealt_out(spark):
    part = spark.range(10_000).selectExpr("id as p_partkey", "'hot bolt' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "7 as p_size").coalesce(1)
    assert B.sources(part).rdd.getNumPartitions() == 3
    files = spark.range(100).selectExpr("concat('a/', id) as path", "'x' as content")
    archives = code.zipped(files, F.lit("a"), 10)
    assert archives.count() == 10 and code.unzipped(archives).select("path", "content").distinct().count() == 100


def test_short_cycles_need_no_components(spark, monkeypatch):
    pairs = [(a, b) for a in range(9) for b in range(9) if (a * 5 + b * 3) % 4 == 1 or a == b == 2]
    edges = spark.createDataFrame([*pairs, (1, None)], "caller long, callee long")
    monkeypatch.setattr(Y, "strong_components", None)
    have = set(pairs)
    want = [(a, b) for a, b in have if a < b and (b, a) in have] + [(a, b, c) for a, b in have for c in range(9) if a < min(b, c) and b != c and (b, c) in have and (c, a) in have] + [(2,)]
    assert sorted(tuple(r["path"]) for r in Y.cycles(edges, 3).collect()) == sorted(want)


def test_cache_uses_its_store_once_a_key():
    calls = []

    class Store:
        def __getattr__(self, name):
            calls.append(name)
            return lambda *a: False if name == "exists" else iter([]) if name == "iterator" else None

    cache = state.ExpiringCache()
    cache.handle = cache.entry = cache.stats = Store()
    rows = pd.DataFrame([(1, "a", i, datetime(2024, 1, 1) + timedelta(minutes=40 * i)) for i in range(50)], columns=["user_id", "event_type", "event_id", "ts"])
    (out,) = cache.handleInputRows((1, "a"), iter([rows]), None)
    assert out["outcome"].tolist() == ["miss", "hit"] * 25 and out["n"].tolist() == [i // 2 + 1 for i in range(50)] and len(calls) <= 8


def test_similar_methods_are_met_once(spark, sf):
    assert "Union" not in QUERIES["q_similar_methods"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_benchmark_summary_has_every_item_and_measure(spark, sf, tmp_path):
    """Hit rate and stability were missing, and items that one of two searches did not find were dropped."""
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")}
    c = tables["benchmark"].columns
    more = spark.createDataFrame([(10_000_001, "zzqqxx wwvvqq"), (10_000_002, "")], "item_id long, text string")
    n = tables["benchmark"].count()
    tables["benchmark"] = tables["benchmark"].unionByName(more, allowMissingColumns=True).select(*c)
    got, want = both(spark, tmp_path / "a", "agg_benchmark_summary", tables)
    assert got == want
    r = QUERIES["agg_benchmark_summary"](spark, str(tmp_path / "a")).first()
    assert r["queries"] == n + 2 and r["avg_jaccard"] == 1.0
    assert 0 < r["hit_rate"] < 1 and math.isclose(r["top1_stability"], n / (n + 2), abs_tol=1e-6)
    got, want = both(spark, tmp_path / "b", "agg_benchmark_summary", {"documents": tables["documents"], "benchmark": tables["benchmark"].limit(0)})
    assert got == want == ["(0.0, 0.0, 0, 0.0)"]
