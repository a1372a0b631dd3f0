"""The pipeline's stages over small tables, each held against a brute-force version of its decision."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from graphloom.llm import pii_crf
from graphloom.llm.cluster import saved
from tests.llm.test_operators import WORD, brute_groups, brute_targets

pt = pytest.importorskip("public_tokenizers")


def test_stages(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "mix", "encode"]
    tables = [docs]
    for name, stage in cp.STAGES:
        out = saved(stage(spark, tables[-1], sf), name)
        if name != "encode":
            assert out.columns == docs.columns
        tables.append(out)
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    start, clean, unique, private, mix, ids = rows

    # Toxicity: rows go whole, none with several known insults stays, few others go.
    insults = {"moron", "loser", "scum", "clown", "stupid", "disgusting", "worthless", "idiot", "pathetic", "trash"}
    count = lambda r: sum(w.strip(".,").lower() in insults for w in r["text"].split())
    left = {r["doc_id"] for r in clean}
    assert all(r["doc_id"] not in left for r in start if count(r) >= 4)
    plain = [r for r in start if not count(r)]
    assert sum(r["doc_id"] in left for r in plain) >= 0.9 * len(plain)

    groups = brute_groups([(r["doc_id"], r["text"]) for r in clean])
    assert sorted(r["doc_id"] for r in unique) == sorted(i for i, _, _, kept in groups if kept)

    before = {r["doc_id"]: r["text"] for r in unique}
    assert len(private) == len(unique)
    for r in private:
        base, _ = pii_crf.base_spans(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) if not base and "[" not in r["text"] else not pii_crf.base_spans(r["text"])[0]
        assert r["n_chars"] == len(r["text"])

    sizes = Counter()
    for r in private:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for r in mix:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    most = max(len(WORD.findall(r["text"])) for r in private)
    assert all(abs(taken[s] - t) <= most for s, t in brute_targets(dict(sizes)).items())

    sp = sentencepiece.SentencePieceProcessor(model_file=pt.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in mix}
    assert len(ids) == len(mix) and all(r["ids"] == sp.encode(text[r["doc_id"]]) for r in ids)


def test_run_is_the_stages(spark, sf):
    a = cp.run(spark, sf).select("doc_id", "n_pieces").collect()
    b = cp.run(spark, sf).select("doc_id", "n_pieces").collect()
    assert a and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_near_dedup_tells_rows_apart(spark, sf):
    """Rows that share an id with the same or another text, and rows without an id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, text(1) + " more"), (3, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (4, ""), (4, None), (5, text(2))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_dedup(spark, saved(df, "docs"), sf)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, text(1)), (1, text(2)), (3, text(3)), (None, text(4)), (4, ""), (4, None)], key=repr)
    assert cp.near_dedup(spark, df.limit(0), sf).count() == 0
