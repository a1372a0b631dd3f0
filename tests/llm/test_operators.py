"""Each operator against a brute-force version, and on the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, context_mixing, license_rules, line_frequency, mih_topk, mixing, pii_crf, piece_transducer, repair_ids, toxicity_chain
from tests.llm import cases

pt = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


# ---- near duplicates ----------------------------------------------------------


def brute_groups(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, s) in enumerate(sets):
        comp = least.get(root(k)) if s else i
        out.append((i, len(s), comp, comp is not None and i == comp))
    return out


def check_groups(df):
    got = [tuple(r) for r in chosen_path.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    want = brute_groups([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_near_duplicates_cases(spark, docs):
    check_groups(docs)
    assert chosen_path.near_duplicates(cases.empty(spark)).count() == 0


def test_near_duplicates_doubled_column(spark):
    assert chosen_path.near_duplicates(cases.doubled(spark)).count() == cases.frame(spark).count()


def test_near_duplicates_large_group(spark, monkeypatch):
    """A group far above the size of a small node, strays near its edge, and a shared passage."""
    r = random.Random(3)
    w = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [w() for _ in range(120)], [w() for _ in range(60)]
    rows = []
    for i in range(120):
        x = list(base)
        for _ in range(r.randint(0, 4)):
            x[r.randrange(len(x))] = w()
        rows.append((i, " ".join(x)))
    rows += [(1000 + i, " ".join(passage + [w() for _ in range(50)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_groups(df)
    for steps in (5, 3, 1):  # nodes in parts, their descendants, and what is left at the last step
        monkeypatch.setattr(chosen_path, "SMALL", 20)
        monkeypatch.setattr(chosen_path, "STEPS", steps)
        check_groups(df)


# ---- quality ---------------------------------------------------------------------


def test_line_frequency(spark, docs):
    got, frequent = line_frequency.line_frequency(docs)
    rows = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert got.count() == docs.count()
    for r in docs.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(5)}
        seen, dups = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        g = rows[r["doc_id"], len(w)]
        assert (g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered))
        assert g["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert line_frequency.line_frequency(cases.empty(spark))[0].count() == 0


def test_frequent_lines_go(spark):
    body = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"{body} {i}\nAccept  ALL cookies", "h") for i in range(40)] + [(100 + i, "accept all cookies\nok", "h") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, frequent = line_frequency.line_frequency(df)
    assert frequent.count() == 1 and frequent.first()["n_docs"] == 43
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(3))
    clean = line_frequency.without_lines(df, frequent)
    assert clean.columns == df.columns and clean.where("lower(text) like '%cookies%'").count() == 0


def test_a_line_goes_alike_in_small_and_large_hosts(spark):
    """The same line, in the same number of documents of a small and of a very large host."""
    body = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(12)])
    line = F.when(F.col("id") % F.when(F.col("source") == "large", 800).otherwise(2) == 0, F.lit("\nall rights reserved by us")).otherwise("")
    small, large = (spark.range(a, b).withColumn("source", F.lit(h)) for a, b, h in ((0, 50, "small"), (100_000, 120_000, "large")))
    df = small.union(large).select(F.col("id").alias("doc_id"), F.concat(body, line).alias("text"), "source")
    _, frequent = line_frequency.line_frequency(df)
    assert {r["host"]: r["n_docs"] for r in frequent.collect()} == {"=small": 25, "=large": 25}
    assert line_frequency.without_lines(df, frequent).where("text like '%reserved%'").count() == 0


# ---- personal data -----------------------------------------------------------------


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_random():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab@.+-0123456789 ()x_%é\n") for _ in range(r.randint(0, 90)))
        assert pii_crf.base_spans(t)[0] == brute_spans(t), t


def test_personal_data(spark, docs):
    got = {(r["doc_id"], r["spans"]): r for r in pii_crf.personal_data(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        base = brute_spans(r["text"] or "")
        g = next(v for k, v in got.items() if k[0] == r["doc_id"] and (r["doc_id"] is not None or v["n_email"] == 0))
        assert [g[f"n_{k}"] for k in pii_crf.KINDS] == [sum(s[0] == k for s in base) for k in pii_crf.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert g["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(g["spans"].split(","))
    clean = pii_crf.redacted(docs.select("doc_id", "text")).where("doc_id = 9").first()["text"]
    assert "[EMAIL]" in clean and "bob@" not in clean and "[CARD]" in clean
    assert pii_crf.personal_data(cases.empty(spark)).count() == 0


def test_secrets(spark):
    text = 'set token = "2abc3ff2ca8fb1e4" and API_KEY: zz/Yx1234567890=\nthe token is here; password = short'
    assert [text[a:b] for _, a, b in pii_crf.secret_spans(text)] == ["2abc3ff2ca8fb1e4", "zz/Yx1234567890="]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_secrets"], r["n_found"]) for r in pii_crf.personal_data(df).collect()} == {1: (2, 2), 2: (0, 0), 3: (0, 0)}
    assert "2abc3" not in pii_crf.redacted(df).where("doc_id = 1").first()["text"]


def test_skip_chain_finds_the_repeat(spark):
    """A phone number is known by its form in one place, and only by its repetition in the other."""
    rows = [(i, f"call +1 (487) 555-{1000 + i} or so and then 555-{1000 + i} once more, page 12-{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = pii_crf.personal_data(df).where("doc_id = 5").first()
    again = rows[5][1].rindex("555-1005")
    assert f"phone:{again}:{again + 8}" in r["spans"].split(",") and r["n_phone"] == 1


def test_shapes_are_of_whole_tokens(spark, monkeypatch):
    shape = pii_crf._shape
    assert len({shape(x, False) for x in ("10.0.0", "10.0.0.255", "10.0.0.2", "10.0", "10.0.0.0.0", "1234567890123", "12345+")}) == 7
    assert shape("x1-" * 50_000, False) == shape("y2-" * 50_000, False) != shape("x1-" * 50_001, False)
    assert len(shape("".join(c * (i % 7 + 1) for i, c in enumerate("1a-" * 300)), True)) <= pii_crf.LONG
    r = np.random.default_rng(2)
    rows = [(i, f"host 10.{r.integers(10)}.{r.integers(10)}.{r.integers(100, 256)} is up") for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, "needs version 10.0.0 or later")], "doc_id long, text string")
    assert pii_crf.personal_data(df).where("doc_id = 1000").first()["spans"] == ""
    assert pii_crf.redacted(df).where("doc_id = 1000").first()["text"] == "needs version 10.0.0 or later"
    # Rare shapes share a row, of which the table has a proven number; nothing is lost from the sums.
    monkeypatch.setattr(pii_crf, "SHAPES", 3)
    odd = spark.createDataFrame([*rows, *[(2000 + i, f"1{'-' * i}x") for i in range(1, 50)]], "doc_id long, text string")
    field = pii_crf.fitted(odd)
    assert 0 < len(field.shape) <= 6
    assert field.unseen.argmax() == 0



# ---- mixing ------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest[s], 1)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix_report(docs).collect()))
    out = mixing.mixed(docs.select("doc_id", "text", "source"))
    assert out.select(F.sum(mixing._size("text"))).first()[0] == sum(taken.values())
    assert mixing.mix_report(cases.empty(spark)).count() == 0


def test_fill_is_exact_where_it_can_be():
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(r.integers(1, 60, 12))
        counts = r.integers(1, 6, len(sizes))
        budget = int(r.integers(0, (sizes * counts).sum() + 1))
        take = mixing.fill(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {x + k * int(s) for x in reach for k in range(c + 1)}
        assert abs(int((sizes * take).sum()) - budget) <= max(1, min(abs(x - budget) for x in reach) + 60)


# ---- token ids -----------------------------------------------------------------------


def test_repair_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 3000):
        seq = np.append(r.integers(0, 6, n), 100).astype(np.uint32)
        seq[n // 2] = 100
        out, left, right = repair_ids.compress(seq, 100)
        flat, starts = repair_ids.expansions(left, right, 100)
        assert (repair_ids.expand(out, flat, starts, 100) == seq).all()
    assert len(out) < 2000


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(1)
    passage = r.integers(0, 5000, 600)
    seq = np.concatenate([x for _ in range(40) for x in (passage, [9000], r.integers(0, 5000, 20), [9000])]).astype(np.uint32)
    for s in (seq, np.append(np.full(70_000, 7), 9000).astype(np.uint32)):
        out, left, right = repair_ids.compress(s, 9000)
        flat, starts = repair_ids.expansions(left, right, 9000)
        assert (repair_ids.expand(out, flat, starts, 9000) == s).all()
        pairs = Counter(zip(out[:-1].tolist(), out[1:].tolist(), strict=True))
        assert all(n < repair_ids.FREQUENT for (a, b), n in pairs.items() if 9000 not in (a, b))
    assert max(np.diff(starts)) > 256
    out, left, right = repair_ids.compress(seq, 9000)
    assert len(out) == 40 * 23  # the passage is one symbol


def test_token_shards(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path, file = f"file://{tmp_path}/shards", pt.path("word_bpe_49k.json")
    repair_ids.write_shards(docs, path, file, block=2000)
    tok = Tokenizer.from_file(file)
    ids = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.select("doc_id", "text").collect()]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = repair_ids.read_shards(spark, path, digest=True).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(((k, len(x), crc(x)) for k, x in ids), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    named = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert named == sorted(named)
    assert repair_ids.read_document(spark, path, 13) == [dict(ids)[13]]
    assert repair_ids.read_document(spark, path, 9) == [dict(ids)[9]] * 2
    none = f"file://{tmp_path}/none"
    repair_ids.write_shards(cases.empty(spark), none, file)
    assert repair_ids.read_shards(spark, none).count() == 0


def test_words_make_the_text():
    tok = repair_ids.tokenizer(pt.path("word_bpe_49k.json"))
    r = random.Random(4)
    for _ in range(400):
        t = "".join(r.choice("abcXYZéÉßİǅ '.,;!?12\n\t ΣσǺ|#") for _ in range(60))
        assert np.frombuffer(tok.encode(t), np.uint16).tolist() == tok.whole.encode(t, add_special_tokens=False).ids, t


# ---- pieces -----------------------------------------------------------------------------


def test_transducer_equals_the_library(spark, docs, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pt.path("piece_bpe_32k.model"))
    m = piece_transducer.PieceTransducer(pt.path("piece_bpe_32k.model"))
    r = random.Random(6)
    texts = ["".join(r.choice("abcdet  .\n-_=<>/129éß日😀(){}▁") for _ in range(120)) for _ in range(300)]
    texts += [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<u4")
        assert ids.tolist() == sp.encode(t), t
        assert m.decode(ids) == sp.decode(ids.tolist())
    got = piece_transducer.digests(docs).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    back = piece_transducer.decoded(piece_transducer.encoded(docs, ["doc_id"])).where("doc_id = 14").first()
    assert back["text"] == docs.where("doc_id = 14").first()["text"]
    assert piece_transducer.digests(cases.empty(spark)).count() == 0


# ---- language model ------------------------------------------------------------------------


def test_lm_scores(spark, docs, sf):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: WORD.findall((t or "").translate(FOLD)) + [None]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = context_mixing.lm_scores(docs).collect()
    want = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t in rows), key=key)
    assert sorted((tuple(r)[:5] for r in got), key=key) == want
    base = sorted(round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6) for _, t in rows)
    assert np.allclose(base, sorted(r["base_score"] for r in got), atol=1e-4)
    assert all(r["score"] < 0 for r in got)
    assert context_mixing.lm_scores(cases.empty(spark)).count() == 0


def lm_texts(spark, sf):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    train = texts[:150]
    tree = context_mixing.Tree(np.bincount(np.frombuffer(b"".join(train), np.uint8), minlength=256), len(train))
    return train, texts[150:], tree, context_mixing.Counts.of(train, [True] * len(train))


def bits_of(mixer, texts):
    by = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.zeros(len(texts))
    out[by] = mixer.bits(context_mixing.Seen([texts[i] for i in by]))
    return out


def test_mixer_learns_and_is_a_distribution(spark, sf):
    train, test, tree, counts = lm_texts(spark, sf)
    mixer = context_mixing.Mixer(tree, counts)
    bits = bits_of(mixer, test)
    assert bits.sum() / sum(map(len, test)) < 3.2
    assert np.allclose(bits[:5], [bits_of(mixer, [t])[0] for t in test[:5]], rtol=1e-4)  # whatever stands beside
    # All one-byte texts, the empty one and the rest: probabilities add up to less than one.
    one = bits_of(mixer, [b"", *[bytes([b]) for b in range(256)]])
    assert 0.0 < (2.0**-one).sum() <= 1.001


def test_contexts_are_full_and_rare_bytes_are_learnt(spark):
    flat = np.random.default_rng(3).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    keys = context_mixing.Seen([flat]).pairs[3][1]
    assert len(np.unique(keys)) == len({flat[max(0, i - 4) : i] for i in range(len(flat) + 1)})  # no two share a key
    line = "".join(chr(0x100 + 7 * i) for i in range(180))  # 140 bytes and more, none of them common
    df = spark.createDataFrame([(i, line) for i in range(60)], "doc_id long, text string")
    assert context_mixing.lm_scores(df).agg(F.max("bits_per_byte")).first()[0] < 1.0
    assert len(context_mixing.Seen([line.encode()]).pairs) == context_mixing.MODELS == 5


def test_counts_are_exact(spark):
    """What follows every context, of all orders and of words, against counting by hand."""
    texts = [b"the cat the hat", b"", b"The cat", "né né".encode()]
    c = context_mixing.Counts.of(texts, [True, True, False, True])
    seen = context_mixing.Seen(texts)
    for k in range(4):
        want = Counter()
        for i, t in enumerate(texts):
            s = [256] * 4 + list(t) + [256]
            want.update((tuple(s[j - k - 1 : j]), s[j]) for j in range(4, len(s)) if i != 2)
        pair, key, sym = seen.pairs[k]
        at = c.at(key)
        got = [{int(c.sym[x]): int(c.n[x]) for x in range(c.ptr[p], c.ptr[p + 1])} for p in at]
        s = np.concatenate([[*list(t), 256] for t in texts])
        assert (seen.sym == s).all()
        by_context = Counter()
        for (ctx, y), n in want.items():
            by_context[y, n] += 1
        assert sorted((y, n) for x in {int(p): g for p, g in zip(at, got, strict=True)}.values() for y, n in x.items()) == sorted(by_context.elements())
    words = context_mixing._word_keys(texts)[0]
    n = [int(c.n[c.ptr[p]]) if c.size[p] else 0 for p in c.at(words)]
    assert n == [2, 1, 2, 1, 2, 1, 2, 2]


def test_counts_travel_well():
    n = np.array([0, 1, 15, 16, 17, 1000, 10**6, 3 * 10**9])
    assert (context_mixing._unrounded(context_mixing._rounded(n[:4])) == n[:4]).all()
    assert np.allclose(context_mixing._unrounded(context_mixing._rounded(n)), n, rtol=0.06)
    for x in (n, n[:0], n.astype("<u4")):
        assert (context_mixing._thawed(context_mixing._frozen(x), x.dtype.str) == x).all()
    place = np.arange(10_000)
    s = context_mixing._strides(place)
    assert (np.diff(s) >= 0).all() and (np.diff(s) <= 1).all() and np.bincount(s)[:64].tolist() == [8] * 64 and np.bincount(s)[64] == 32 and np.bincount(s).max() == 128


def test_pieces_add_up_over_blocks(spark, sf, monkeypatch):
    """Scores do not depend on how texts are dealt over blocks and pieces."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    once = {r["doc_id"]: r for r in context_mixing.lm_scores(docs).collect()}
    monkeypatch.setattr(context_mixing, "BLOCK", 20_000)
    for r in context_mixing.lm_scores(docs.repartition(5)).collect():
        assert tuple(r)[:5] == tuple(once[r["doc_id"]])[:5]
        assert math.isclose(r["base_score"], once[r["doc_id"]]["base_score"], rel_tol=1e-9)
        assert math.isclose(r["score"], once[r["doc_id"]]["score"], rel_tol=0.05)  # the blocks' first weights differ a little


def test_mixing_starts_trained_and_learns_in_short_texts(spark, sf, monkeypatch):
    train, test, tree, counts = lm_texts(spark, sf)
    test = [t[:300] for t in test]
    plain = context_mixing.Mixer(tree, counts)
    trained = context_mixing.Mixer(tree, counts, context_mixing.Start(plain.fit(context_mixing.Seen(train))))
    live = bits_of(trained, test)
    assert live.sum() < bits_of(plain, test).sum()
    monkeypatch.setattr(context_mixing, "RATE", 0.0)
    still = bits_of(trained, test)
    assert (np.abs(live - still) > 1e-3).mean() > 0.9  # also texts under 512 bytes are learnt from as they go
    # The parts of the training texts add up, in whatever order.
    halves = sum(plain.fit(context_mixing.Seen(x)) for x in (train[75:], train[:75]))
    assert np.allclose(context_mixing.Start(halves).weights, trained.start.weights, atol=0.1)


# ---- toxicity ---------------------------------------------------------------------------------


def test_toxicity_chain(spark, sf):
    d = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet")
    lab = spark.read.parquet(sf.replace("0.001", "0.1") + "/labels.parquet")
    cut = F.crc32(F.col("doc_id").cast("string")) % 4
    chain = toxicity_chain.standard_chain(d, lab.where(cut != 0))
    p = chain.score(d).join(lab.where(cut == 0), "doc_id").select("p_toxic", "toxic").collect()
    hit = [(r["p_toxic"] >= 0.5, r["toxic"] == 1) for r in p]
    assert sum(a and b for a, b in hit) >= 0.75 * sum(b for _, b in hit)
    assert sum(a and not b for a, b in hit) <= 0.01 * sum(not b for _, b in hit)


def test_toxicity_cases(spark, docs):
    lab = spark.createDataFrame([(i, i % 2, int(i > 130)) for i in range(100, 160)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity_chain.standard_chain(docs, lab)
    assert chain.score(docs).count() == docs.count()
    assert chain.score(docs, keep=True).columns[: len(docs.columns)] == docs.columns
    none = toxicity_chain.standard_chain(docs, lab.where("doc_id < 0"))
    assert none.score(docs).where("p_toxic > 0.01").count() == 0
    assert chain.score(cases.empty(spark)).count() == 0


# ---- licenses ------------------------------------------------------------------------------------

LWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text):
    w = LWORD.findall((text or "").translate(FOLD))
    places = []
    for phrase, label in license_rules.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    norm, found = " ".join(w), []
    if any(t in norm for t in license_rules.TRIGGERS):
        for prio, label, word, pattern, score in license_rules.rules():
            if word in norm:
                for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", norm):
                    a = norm[: m.start()].count(" ")
                    found.append((prio, label, score, a, a + m.group().count(" ") + 1))
    kept = []
    for d in found:
        better = [e for e in found if e[3] <= d[3] and e[4] >= d[4] and (e[0] < d[0] or e[0] == d[0] and (e[4] - e[3] > d[4] - d[3] or e[4] - e[3] == d[4] - d[3] and e[1] < d[1]))]
        if not better:
            kept.append(d)
    base = {x for _, x in places}
    return (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[1] for d in kept})))


def test_license_rules(spark, docs):
    assert 200 < len(license_rules.rules())
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: Apache-2.0\nlicensed under the Apache License, Version 2.0",
        "GNU Lesser General Public License v2.1 only; the GPL version 2 or any later version. BSD 3-Clause License",
        "All Rights Reserved all rights reserved, CC BY-SA 4.0 and creative commons attribution 3.0",
    ]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, more):
        got = license_rules.license_scan(df).drop("detections", "score").collect()
        want = [(r["doc_id"], *brute_licenses(r["text"])) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    labels = {r["doc_id"]: r["labels"].split(",") for r in license_rules.license_scan(more).collect()}
    assert labels[500] == ["mit"] and labels[501] == ["apache-2.0"] and "lgpl-2.1-only" in labels[502] and "gpl-2.0-or-later" in labels[502]
    assert license_rules.license_scan(cases.empty(spark)).count() == 0


def alternatives(parsed):
    """Strings of a pattern that take every branch of it, one at a time."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg])
        elif name == "MAX_REPEAT":
            parts.append([*([""] if arg[0] == 0 else []), *[x * max(arg[0], 1) for x in alternatives(arg[2])]])
        elif name == "SUBPATTERN":
            parts.append(alternatives(arg[3]))
        else:
            assert name == "BRANCH"
            parts.append([x for branch in arg[1] for x in alternatives(branch)])
    first = [p[0] for p in parts]
    return list(dict.fromkeys("".join([*first[:k], x, *first[k + 1 :]]) for k, p in enumerate(parts) for x in p))


def test_license_gates_drop_nothing(spark, monkeypatch):
    from re import _parser

    texts = []
    for _, label, word, pattern, _ in license_rules.rules():
        for x in alternatives(_parser.parse(pattern)):
            assert re.fullmatch(pattern, x)
            assert word in x and any(t in x for t in license_rules.TRIGGERS), (label, x)
            texts.append(x)
    df = spark.createDataFrame([(i, f"some {x} words") for i, x in enumerate(dict.fromkeys(texts[::7]))], "doc_id long, text string").repartition(8).cache()
    gated = sorted(license_rules.license_scan(df).collect())
    assert all(r["labels"] for r in gated)
    plain = [(*r[:2], "", *r[3:]) for r in license_rules.rules()]
    monkeypatch.setattr(license_rules, "TRIGGERS", ("",))
    monkeypatch.setattr(license_rules, "rules", lambda: plain)
    assert gated == sorted(license_rules.license_scan(df).collect())


def test_license_names_without_gates_or_space(spark):
    texts = {"Licensed under AGPL-3.0": "agpl-3.0", "Released under the BSD 3-Clause terms": "bsd-3-clause", "CC Attribution-ShareAlike 4.0": "cc-by-sa-4.0", "under GPLv3": "gpl-3.0", "LGPLv2.1 only": "lgpl-2.1-only", "AGPLv3 or later": "agpl-3.0-or-later"}
    df = spark.createDataFrame(list(texts.items()), "text string, doc_id string")
    got = {r["doc_id"]: r["labels"] for r in license_rules.license_scan(df).collect()}
    assert got == {x: x for x in texts.values()}


# ---- top-k -------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(size=40).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, [1.0]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mih_topk.top_k(df, F.col("id") % 20 == 0, k=7).collect()
    codes = [(i, tuple(x > 0 for x in v)) for i, v in rows if v and len(v) == 40 and i is not None]
    want = []
    for q, c in {x for x in codes if x[0] % 20 == 0}:
        near = sorted((sum(a != b for a, b in zip(c, d)), i) for i, d in codes)[:7]
        want += [(q, k + 1, i, dist) for k, (dist, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert mih_topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_block_search_covers():
    r = np.random.default_rng(8)
    codes = r.integers(0, 1 << 16, (30000, 2)).astype(np.uint16)
    queries = codes[:40]
    q, c, d = mih_topk.search(codes, queries, np.ones(len(codes), np.int64), 10)
    for k in range(40):
        full = np.sort(mih_topk._BITS[codes ^ queries[k]].sum(axis=1))[:10]
        assert (np.sort(d[q == k])[:10] == full).all()
    assert len(c) < 40 * 30000 * 0.6
