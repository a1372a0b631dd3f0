"""Scores inside tasks: no pair of a document and a query is a row, whatever the rounds and slices."""

import math
import random

from pyspark.sql import functions as F

from graphloom.operators import scoring as P
from graphloom.operators import search as S
from graphloom.operators import wordindex as N


WORDS = [a + b for a in ("red", "ring", "bolt", "cold", "parser") for b in ("", "s", "top", "ly", "ways")]


def tables(spark, docs=90, asked=14):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    have = [(i, text(r.randint(0, 12)) or None) for i in range(docs)]
    queries = [(q, text(r.randint(1, 5))) for q in range(asked)]
    return have, queries, spark.createDataFrame(have, "id long, text string").repartition(3), spark.createDataFrame(queries, "query long, text string")


def test_pairs_are_no_rows(spark, monkeypatch):
    have, queries, docs, asked = tables(spark)
    monkeypatch.setattr(P, "ROUND", 4)
    got = S.overlap(docs, "id", "text", asked, 5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for q, x in queries:
        rows = []
        for i, y in have:
            a, b = set(x.split()), set((y or "").split())
            if a & b:
                rows.append((-math.floor(min(len(a & b) / len(a | b) + 0.1 * (x in y), 1.0) * 1e6 + 0.5) / 1e6, i))
        want[q] = [(i, -s) for s, i in sorted(rows)[:5]]
    for q in want:
        assert [(r["id"], r["score"]) for r in got.where(F.col("query") == q).orderBy("rank").collect()] == want[q]


def test_okapi_in_rounds(spark, monkeypatch):
    have, queries, docs, asked = tables(spark)
    terms = asked.select("query", F.explode(F.split("text", " ")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    lists = S.term_lists(docs, "id", "text").cache()
    once = sorted(map(tuple, S.bm25(lists, terms, 7, len(have)).collect()))
    monkeypatch.setattr(P, "ROUND", 3)
    many = S.bm25(lists, terms, 7, len(have))
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, many.collect())) == once and len({r[0] for r in once}) == len(queries)
    assert sorted(map(tuple, S.term_rows(lists).where("id < 3").select("id", "term", "tf").collect())) == sorted((i, w, y.split().count(w)) for i, y in have[:3] for w in set((y or "").split()))
    most = {(r["query"], r["id"]): r["score"] for r in S.longest_use(lists, terms, 100).collect()}
    assert most == {(q, i): max(y.split().count(w) for w in x.split()) for q, x in queries for i, y in have if y and set(x.split()) & set(y.split())}


def test_forgiving_search_in_rounds(spark, monkeypatch):
    have, queries, docs, asked = tables(spark)
    terms = asked.select("query", F.explode(F.split("text", " ")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    post = N.field_postings(docs, {"content": F.split("text", " ")})
    once = sorted(map(tuple, N.forgiving_search(post, terms, {}, len(have), 6).collect()))
    monkeypatch.setattr(N, "WIDE", 3)
    many = N.forgiving_search(post, terms, {}, len(have), 6)
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, many.collect())) == once and once


def test_best_keeps_ties_by_id():
    best = P.Best(P.np.array([7, 8]), 2)
    for ids in ([5, 3], [4, 1], [2, 9]):
        best.add(P.np.array([0, 0]), P.np.array(ids), P.np.array([1.0, 1.0]))
        best.settle()
    (rows,) = best.rows()
    assert rows.to_pydict() == {"query": [7, 7], "id": [1, 2], "score": [1.0, 1.0]}


def test_words_that_answer_do_not_pass_the_driver(spark, monkeypatch):
    """All words near the asked ones, or begun by them, were collected; a task has those of its part."""
    texts = [(i, f"an{chr(97 + i % 26)}{chr(97 + i // 26)} word{i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "an", 1), (1, "word7", 1), (2, "an", 1)], "query long, term string, qf long")
    post = N.field_postings(docs, {"content": F.split("text", " ")})
    rows, collect = [], type(post).collect
    monkeypatch.setattr(type(post), "collect", lambda df: rows.append(collect(df)) or rows[-1])
    monkeypatch.setattr(N, "WIDE", 50)
    found = N.forgiving_search(post, asked, {}, 300, 5)
    assert max(map(len, rows)) <= 3
    first = [r["id"] for r in found.where("query = 1").orderBy("rank").collect()]
    assert first[0] == 7 and len(first) == 5 and found.where("query = 2").count() == 5
