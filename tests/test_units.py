"""Each part of a unit's score by hand: lists, weights, age, its floor, questions without words."""

from graphloom.operators import units


def test_relevant(spark):
    rows = [(1, ["a", "a", "b"], ["a"], ["b"], 0), (2, ["a"], None, [], 3), (3, ["b"], ["b"], None, 30), (4, ["c"], ["c"], ["c"], 1), (5, None, None, None, None)]
    have = spark.createDataFrame(rows, "id long, keywords array<string>, topic array<string>, summary array<string>, days int")
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["zz"])], "query long, words array<string>")
    got = sorted(tuple(r) for r in units.relevant(have, asked, 2).select("query", "rank", "id", "score").collect())
    assert got == [(1, 1, 1, 5.5), (1, 2, 3, 1.5), (2, 1, 1, None), (2, 2, 4, None), (3, 1, 1, None), (3, 2, 4, None)]
    every = {r["id"]: r["score"] for r in units.relevant(have, asked.where("query = 1"), 9).collect()}
    assert every == {1: 5.5, 3: 1.5, 2: 0.7}
    assert units.relevant(have.limit(0), asked, 2).count() == 0
