"""Lexical search, hard negatives and token counts against brute force, and on the awkward cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bpe_counts, maxscore, pivot_mining
from tests.llm import cases

pt = pytest.importorskip("public_tokenizers")
TERM = re.compile(maxscore.TERM)
FOLD = {i: i + 32 for i in range(65, 91)}


# ---- ranked lexical search ----------------------------------------------------


def brute_ranking(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["one two", "ONE", "", None, "licensed under CC by 4", "éß 日本語 nothing", "a b c d e ab bc", "same line last same", "mail bob example com 10 0 255", "zzzz not there"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "same"), (None, "text with no id"), (20, cases.rows()[0][1]), (21, cases.rows()[12][1][:3000])]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int")


@pytest.mark.parametrize("sizes", [{}, {"postings": 40, "shard_docs": 3}, {"postings": 500, "shard_docs": 20, "round_bytes": 60}])
def test_ranked_search(spark, asked, sizes):
    rows, items = asked
    want = sorted(brute_ranking([r[:2] for r in cases.rows()], rows), key=repr)
    assert len(want) > 40
    for docs in (cases.frame(spark), cases.doubled(spark).repartition(5)):
        got = maxscore.top_documents(docs, items, **sizes)
        assert rows_of(got.select("item_id", "rank", "doc_id", "score")) == want


def test_ranked_search_of_nothing(spark, asked):
    _, items = asked
    assert maxscore.top_documents(cases.empty(spark), items).count() == 0
    assert maxscore.top_documents(cases.frame(spark), items.limit(0)).count() == 0
    assert maxscore.top_documents(cases.frame(spark), items.where("item_id in (2, 3, 9)")).count() == 0
    assert maxscore.top_documents(cases.frame(spark).where("text is null or text = ''"), items).count() == 0


def test_text_items_and_fewer_than_k(spark):
    docs = spark.createDataFrame([(3, "x y"), (1, "Y x"), (2, "q r")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "X"), ("b", "nope")], "item_id string, text string")
    got = [tuple(r) for r in maxscore.top_documents(docs, items, k=1).collect()]
    w = math.floor(1000 * math.log(8 / 5))
    assert got == [("a", 1, 1, w * (10**9 // (1000 + 800)))]
    assert maxscore.top_documents(docs, items).count() == 2


def test_shards_skip_and_agree():
    """Non-essential lists are probed and not merged, and the best are those of a full sum."""
    r = random.Random(3)
    n, wide = 5000, 30
    shard = maxscore._Shard()
    sizes = np.array([r.randint(5, 300) for _ in range(n)])
    text, term = [], []
    for d in range(n):
        for t in {0, 1, 2, *(int(wide * r.random() ** 3) for _ in range(6))} if r.random() < 0.9 else {29}:
            text += [d] * r.randint(1, 4)
            term += [t] * (len(text) - len(term))
    shard.add(list(range(n)), sizes, np.array(text), np.array(term), wide)
    row = shard.batch().to_pylist()[0]
    docs, words = n, int(sizes.sum())
    df = np.bincount([t for _, t in set(zip(text, term, strict=True))], minlength=wide)
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    search = maxscore.ShardSearch(row, weight, docs, words)
    tf = Counter(zip(text, term, strict=True))
    for asked in ([0, 1, 2, 25, 28], [0, 5, 9, 29], [29], list(range(wide))):
        full = np.zeros(n, np.int64)
        for (d, t), f in tf.items():
            if t in asked:
                full[d] += weight[t] * ((10**9 * f) // (1000 * f + 8 * (10 + (90 * docs * sizes[d]) // words)))
        want = sorted((-s, d) for d, s in enumerate(full) if s > 0)[:10]
        at, score = search.top(np.array(asked), 10)
        assert [(-s, d) for d, s in zip(at, score, strict=True)] == want
        floor = -want[-1][0]
        at, score = search.top(np.array(asked), 10, floor)
        assert [(-s, d) for d, s in zip(at, score, strict=True)] == want
    assert search.probed > 0


# ---- hard negatives -----------------------------------------------------------


def brute_negatives(rows, every=5, positives=5, negatives=3):
    best: dict = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * y) for y in v]
        if sum(y * y for y in x) < 2**62 and (i not in best or (label, v) < best[i][:2]):
            best[i] = (label, v, x)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (label, _, x) in best.items():
        if a % every:
            continue
        scored = [(-dot(x, y), i, other) for i, (other, _, y) in best.items() if i != a]
        for s, p, _ in sorted(z for z in scored if z[2] == label)[:positives]:
            far = sorted(z for z in scored if z[2] != label and 50 * -s <= 100 * -z[0] <= 95 * -s)[:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(far)]
    return out


def vectors(n=400, wide=12, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, wide))
    out = []
    for i in range(n):
        c = int(r.integers(6))
        v = np.float32(centres[c] * 0.5 + r.normal(size=wide) * r.choice([0.1, 0.5, 1.5])).tolist()
        out.append((i, c % 4, v))
    out += [(1000 + i, out[i % 7][1], out[i % 7][2]) for i in range(40)]  # copies: ties
    return out + [(None, 1, out[0][2]), (2000, None, out[0][2]), (2005, 1, None), (2010, 1, [None] * wide), (2015, 1, [float("nan")] * wide), (2020, 2, [float("inf")] * wide), (2025, 1, [0.0] * wide), (2030, 1, out[3][2][:5]), (2035, 1, []), (2040, 3, [1e30] * wide), (10, 3, out[10][2])]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 60, "block_anchors": 20}])
def test_hard_negatives(spark, sizes):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, rank int, id int")
    want = sorted(brute_negatives([(i, c, v and [np.float32(x).item() if x is not None else None for x in v]) for i, c, v in rows]))
    assert len(want) > 300
    got = pivot_mining.hard_negatives(df.select("*", "rank"), pivot_mining.F.col("id") % 5 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert pivot_mining.hard_negatives(df, pivot_mining.F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(5, 1, [1.0])], df.schema)
    assert pivot_mining.hard_negatives(one, pivot_mining.F.col("id") % 5 == 0).count() == 0


def test_pivots_leave_rows_out_and_lose_none():
    """Scores outside the brackets are never computed; what is found equals a full sort."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 300
    x = np.floor(centres[r.integers(40, size=6000)] + r.normal(size=(6000, 16)) * 20)
    norm = (x * x).sum(axis=1)
    top = norm.max()
    at = pivot_mining._apart(x[:512], norm[:512], top, 16)
    own = np.sqrt(np.maximum(top - norm, 0))
    far = np.sqrt(np.maximum(2 * top - 2 * (x @ x[at].T + own[:, None] * own[at]), 0))
    block = pivot_mining.PivotBlock(np.arange(6000), r.integers(3, size=6000), x, far, top)
    for q in range(0, 6000, 300):
        away = np.sqrt(np.maximum(norm[q] + top - 2 * x[q] @ x[at].T, 0))
        scores = x @ x[q]
        full = sorted((-int(s), i) for i, s in enumerate(scores))
        hi = int(0.9 * -full[5][0])
        first, second = block.best(x[q], away, norm[q], lambda at: np.ones(len(at), bool), [(-np.inf, np.inf), (hi // 2, hi)], 5)
        assert [(s, int(block.ids[0]) * 0 + i) for s, i in first] == full[:5]
        assert second == [f for f in full if hi // 2 <= -f[0] <= hi][:5]
    assert block.skipped > 0


def test_large_components_are_exact(spark):
    big = [3.0e6 + i * 1000 for i in range(8)]
    rows = [(i, i % 2, [b * (1 if i % 3 else -1) + i * 7 for b in big]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = pivot_mining.hard_negatives(df, pivot_mining.F.col("id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(brute_negatives(rows))


# ---- token counts -------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, library):
    path, tok = library
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in cases.rows())
    for docs in (cases.frame(spark), cases.doubled(spark).repartition(3)):
        got = bpe_counts.token_counts(docs, path)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == want
    assert bpe_counts.token_counts(cases.empty(spark), path).count() == 0


def test_token_counts_random(library, monkeypatch):
    path, tok = library
    c = bpe_counts.PairCounter(path)
    r = random.Random(8)
    letters = [*"abcdefgh ABC'stmd  \n\t.,!?019<|>_", "<|endoftext|>", "<|endoftext|", "é", "ñ", "日本", "😀", " ", "　", "՘", "ſ", "İ", "'ll", "'re", " '", "\x1c", "\x85", "​", "²", "Ⅷ", "\U00010940", "\U0003fbdc", "\x00"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(20000)]
    for t, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.count(t) == len(want.ids), (t, want.tokens)
    monkeypatch.setattr(bpe_counts, "PIECE", 7)
    monkeypatch.setattr(bpe_counts, "CACHE", 50)
    for t, want in zip(texts[:5000], tok.encode_batch(texts[:5000], add_special_tokens=False), strict=True):
        assert c.count(t) == len(want.ids), t


def test_characters_are_of_the_librarys_kinds(library):
    path, tok = library
    c = bpe_counts.PairCounter(path)
    for lo in [*range(0, 0x3000, 3), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= lo < 0xE000:
            text = "a" + chr(lo) + "1!" + chr(lo) + " " + chr(lo)
            ends = np.cumsum([0, *map(len, c.parts(text))])
            assert [o for _, o in tok.pre_tokenizer.pre_tokenize_str(text)] == list(zip(ends[:-1], ends[1:], strict=True)), hex(lo)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "9" * 100_000, "日本語" * 30_000, " " * 100_000, "the cat\n" * 20_000])
def test_long_runs(library, text):
    path, tok = library
    assert bpe_counts.PairCounter(path).count(text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_counts.PairCounter(pt.path("word_bpe_49k.json"))


def test_sizes_of_batches():
    """Every row of a batch has its place, bad ones too."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([[1.0, None], [], [0.5, -0.5]], pa.list_(pa.float64()))], names=["id", "label", "v"])
    got = next(pivot_mining._rounded(256)(iter([batch]))).to_pylist()
    assert [(r["id"], np.frombuffer(r["v"], "<i4").tolist(), r["norm"]) for r in got] == [(2, [], 0.0), (3, [128, -128], 32768.0)]
