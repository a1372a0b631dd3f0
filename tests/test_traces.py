"""Traces inside others against brute force."""

import random

from graphloom.operators import traces as T


def inside(a, b):
    return len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))


def follows(path, asked):
    rest = iter(path)
    return all(x in rest for x in asked)


def test_longest(spark):
    r = random.Random(1)
    traces = [[r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(150)] + [["hot", "x"], ["hot", "y", "z"], ["y", "z"], None]
    got = sorted(x["path"] for x in T.longest(spark.createDataFrame([(t,) for t in traces + traces], "path array<string>")).collect())
    all_ = {tuple(t) for t in traces if t is not None}
    assert got == sorted(list(t) for t in all_ if not any(inside(t, b) for b in all_)) and ["y", "z"] not in got
    assert T.longest(spark.createDataFrame([], "path array<string>")).count() == 0
    assert T.longest(spark.createDataFrame([([],), ([],)], "path array<string>")).count() == 1


def test_subsequences(spark):
    r = random.Random(2)
    paths = [(i, [r.choice("abcdef") for _ in range(r.randint(0, 9))]) for i in range(80)] + [(500, ["a", None, " b "]), (501, None), (0, ["f"])]
    asked = [(i, [r.choice("abcdef") for _ in range(r.randint(1, 4))]) for i in range(30)] + [(90, ["", "b"]), (91, ["zz"]), (92, []), (93, None), (94, ["a", "b", "a"]), (0, ["f"])]
    clean = lambda p: [(x or "").strip() for x in p]
    want = sorted((a, i) for a, nodes in asked if nodes for i, p in paths if p is not None and follows(clean(p), clean(nodes)))
    got = T.subsequences(spark.createDataFrame(asked, "ask long, nodes array<string>"), spark.createDataFrame(paths, "id long, path array<string>"))
    assert sorted(tuple(x) for x in got.collect()) == want and (90, 500) in want
    assert T.subsequences(spark.createDataFrame([], "ask long, nodes array<string>"), spark.createDataFrame(paths, "id long, path array<string>")).count() == 0
