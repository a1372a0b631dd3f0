"""Strongly connected components and cycles against brute force and planted cycles."""

import random

from graphloom.operators import cycles as C


def table(spark, pairs):
    return spark.createDataFrame(pairs, "caller long, callee long").cache()


def reach(pairs):
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[n] = seen
    return out


def brute_components(pairs):
    to = reach([p for p in pairs if p[0] != p[1]])
    group = {n: {m for m in to if m in to[n] and n in to[m]} for n in to}
    return {n: min(g) for n, g in group.items() if len(g) > 1}


def brute_cycles(pairs, most):
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = set()

    def walk(path):
        for b in after.get(path[-1], ()):
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < most:
                walk([*path, b])

    for a in after:
        walk([a])
    return out


def check(spark, pairs, most):
    df = table(spark, pairs)
    assert {r["node"]: r["comp"] for r in C.strong_components(df).collect()} == brute_components(pairs)
    got = [tuple(r["path"]) for r in C.cycles(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(pairs, most)
    return got


def test_planted_cycles(spark):
    """Cycles of 2, 3, 5 and 8 nodes, joined by edges that close nothing, with tails, a loop and repeats."""
    pairs, at = [], 0
    for n in (2, 3, 5, 8):
        pairs += [(at + i, at + (i + 1) % n) for i in range(n)] + [(at, at + n), (at, at + n)]
        at += n
    pairs += [(at, at + 1), (at + 1, at + 2), (100, 0), (at + 2, at + 2)]
    assert sorted(map(len, check(spark, pairs, 8))) == [1, 2, 3, 5, 8]


def test_random_graph(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 14), r.randint(0, 14)) for _ in range(30)]
    check(spark, pairs, 4)


def test_nothing(spark):
    assert C.cycles(table(spark, [(1, 2), (2, 3), (None, 1), (3, None)]), 5).count() == 0
