"""Vector search and the trained index against brute force."""

import math

import numpy as np
import pytest

from graphloom.operators import vectors as V


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8)) * 4
    x = [(i, (centres[i % 12] + r.normal(size=8)).tolist()) for i in range(600)]
    x += [(1000 + i, x[i][1]) for i in range(5)]  # ties
    bad = [(2000, None), (2001, [1.0] * 7), (2002, [None] * 8), (2003, [math.nan] * 8), (2004, [math.inf] * 8), (None, [1.0] * 8), (2005, [])]
    return x, spark.createDataFrame(x + bad, "vec_id long, v array<double>").cache()


def brute(x, asked, k, metric="l2"):
    out = []
    for q, v in asked:
        d = []
        for i, w in x:
            a, b = np.array(v), np.array(w)
            d.append((round(((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / math.sqrt((a @ a) * (b @ b)), 6) + 0.0, i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(d)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("sizes", [{}, {"block": 50, "asked_block": 7}])
def test_nearest(rows, metric, sizes):
    x, df = rows
    got = V.nearest(df, df.where("vec_id % 20 = 0 or vec_id > 1000"), "vec_id", "v", 6, metric, **sizes)
    assert sorted((r["query"], r["id"], r["rank"]) for r in got.collect()) == brute(x, [r for r in x if r[0] % 20 == 0 or r[0] > 1000], 6, metric)
    assert V.nearest(df.limit(0), df, "vec_id", "v", 3).count() == 0 and V.nearest(df, df.limit(0), "vec_id", "v", 3).count() == 0


def test_zero_vectors_have_no_angle(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, v array<double>")
    assert [(r["query"], r["id"], r["distance"]) for r in V.nearest(df, df, "vec_id", "v", 1, "cosine").orderBy("query").collect()] == [(1, 1, 1.0), (2, 2, 0.0)]


def lloyd(x, cells, rounds):
    import hashlib

    first = sorted(x, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))[:cells]
    centres, v = np.array([r[1] for r in first]), np.array([r[1] for r in x])
    for _ in range(rounds):
        near = ((v[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(cells):
            if (near == c).any():
                centres[c] = v[near == c].mean(axis=0)
    return centres


def test_training_is_lloyds(rows):
    """Also with centres that come in groups of two."""
    x, df = rows
    want = lloyd(x, 15, 3)
    for bytes_ in (V.CENTRES, 2 * 8 * 8):
        got = V.trained(V.usable(df, "vec_id", "v"), 15, 3, bytes_).orderBy("cell").collect()
        assert np.allclose([r["c"] for r in got], want)


def test_index(rows, spark):
    """Every usable row is filed once, in its nearest cell; all cells together find all; recall rises with the probes."""
    x, df = rows
    index = V.CellIndex.built(df, "vec_id", "v", cells=12, rounds=5, centre_bytes=5 * 64)
    filed = index.lists.collect()
    assert sorted(r["id"] for r in filed) == sorted(i for i, _ in x)
    centres = np.array([r["c"] for r in index.centres.orderBy("cell").collect()])
    assert all(((np.array(r["v"]) - centres) ** 2).sum(axis=1).argmin() == r["cell"] for r in filed)
    asked = df.where("vec_id % 20 = 0")
    exact = V.nearest(df, asked, "vec_id", "v", 10).cache()
    whole = index.search(asked, "vec_id", "v", 10, 12, block=9, asked_block=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))
    few = [V.recall(index.search(asked, "vec_id", "v", 10, p), exact) for p in (1, 3)]
    assert few[0] <= few[1] and few[1] >= 0.9
    assert index.calibrated(asked, "vec_id", "v", 10) <= 4
    empty = V.CellIndex.built(df.limit(0), "vec_id", "v")
    assert empty.lists.count() == 0 and empty.search(asked, "vec_id", "v", 3, 2).count() == 0


def test_recall_of_the_query(spark, sf):
    from graphloom import catalog

    q = catalog.queries()
    assert V.recall(q["s_knn_ivf"](spark, sf), q["s_knn_l2"](spark, sf)) >= 0.9
