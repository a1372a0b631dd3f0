"""Query plans and match scores against a plain version and by hand."""

import random

from graphloom.operators import matching as M
from graphloom.operators import symbols as Z


def table(spark, rows):
    return spark.createDataFrame(rows, "query long, text string")


def plans_of(spark, *texts):
    return [[(r["kind"], r["text"]) for r in M.query_plans(table(spark, [(1, t)])).orderBy("plan").collect()] for t in texts]


def test_plans(spark):
    got = plans_of(spark, "  find the loader AND then parse it, ship a;b ", "one", " ", "stand by the band", "a, b, c, d, e, f, g", "x, x")
    root = "find the loader AND then parse it, ship a;b"
    assert got[0] == [("primary", root), ("segment", "find the loader"), ("segment", "parse it"), ("segment", "ship a"), ("segment", "b"), ("bridge", "find the loader b")]
    assert got[1] == [("primary", "one")] and got[2] == [] and got[3] == [("primary", "stand by the band")]
    assert len(got[4]) == 6 and got[4][-1] == ("segment", "e")
    assert got[5] == [("primary", "x, x"), ("segment", "x")]


def test_words_names_and_hints(spark):
    df = table(spark, [(1, r"the getName of load_all in Averylongword src/main.py, C:\x\y.ts or a.md 请帮我 文件 x 项目")])
    r = df.select(M.query_terms(M.F.col("text")).alias("t"), M.exact_identifiers(M.F.col("text")).alias("i"), M.path_hints(M.F.col("text")).alias("h")).first()
    assert r["t"] == ["getname", "of", "load_all", "in", "averylongword", "src", "main", "py", "ts", "or", "md", "请帮我", "文件"]
    assert r["i"] == ["getname", "load_all", "averylongword"] and r["h"] == ["src/main.py", "C:/x/y.ts", "a.md"]


def plain(path, text, plan):
    """The score from the definition, one string after the other."""
    query, terms, names, hints = plan
    s = sum(22 * (t in path) + 11 * min(text.count(t), 8) for t in terms)
    for h in (x.lower() for x in hints):
        last = h.rsplit("/", 1)[-1]
        s += 30 if h in path else 20 if last and last in path else 0
    s += 25 if len(query) >= 6 and query.lower() in text else 0
    for n in names:
        s += 45 * (n in path) + 18 * min(text.count(n), 4)
        s += 120 if f"def {n}(" in text else 100 if f"class {n}" in text or f"function {n}(" in text else 80 if f"const {n} =" in text or f"let {n} =" in text else 0
    return s + 2 * path.endswith(M.CODE) if s else 0


def test_each_part_counts(spark):
    """One document for every weight."""
    docs = [("q/word.md", ""), ("q", "word " * 9), ("src/a.md", ""), ("q/a.md", ""), ("q", "x the word is here"), ("load_all", ""), ("q", "load_all " * 6), ("q", "def load_all("), ("q", "class load_all"), ("q", "function load_all("), ("q", "const load_all ="), ("q", "let load_all ="), ("q.py", "word"), ("q.py", "none")]
    plans = [("the word is", ["word", "is"], [], []), ("load_all", ["load_all"], ["load_all"], []), ("src/a.md", [], [], ["src/a.md"])]
    m = M.Matcher([(i, 0, "primary", 1.0, *p) for i, p in enumerate(plans)])
    got = [dict(zip(*map(list, m.scores(p, t)), strict=True)) for p, t in docs]
    assert got == [{i: s for i, plan in enumerate(plans) if (s := plain(p, t, plan))} for p, t in docs]
    assert got[0][0] == 22 and got[1][0] == 88 and got[2][2] == 30 + 25 * 0 and got[3][2] == 20 and got[6][1] == 6 * 11 + 72 + 25 and got[12][0] == 13 and got[13] == {}


def test_matches_random(spark):
    r = random.Random(4)
    words = ["abc", "bc", "c_d", "Get_Name", "aaa", "aa", "def", "x/y", "文件", "and", ","]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    asked = table(spark, [(i, text(6)) for i in range(12)] + [(99, None), (98, "")])
    rows = [(i, r.choice(["x/y.py", "abc/z.md", None, "q"]), text(r.randint(0, 12)) if i % 9 else None) for i in range(60)] + [(None, "q", "abc")]
    docs = spark.createDataFrame(rows, "id long, path string, text string").repartition(3)
    plans = M.query_plans(asked).cache()
    full = plans.select("*", M.query_terms(M.F.col("text")).alias("t"), M.exact_identifiers(M.F.col("text")).alias("i"), M.path_hints(M.F.col("text")).alias("h")).collect()
    want = []
    for q in {p["query"] for p in full}:
        scored = []
        for i, path, t in rows:
            best = max(((round(plain((path or "").lower(), (t or "").lower(), (p["text"], p["t"], p["i"], p["h"])) / 10 * p["weight"], 4), -p["plan"]) for p in full if p["query"] == q), default=(0, 0))
            if i is not None and best[0] > 0:
                scored.append((-best[0], len(path or ""), i, -best[1]))
        want += [(q, i, p, -s, n + 1) for n, (s, _, i, p) in enumerate(sorted(scored)[:5])]
    for size in (M.ROUND, 5):
        got = M.matches(docs, plans, 5, size)
        assert sorted((x["query"], x["id"], x["plan"], x["score"], x["rank"]) for x in got.collect()) == sorted(want)
    assert M.matches(docs.limit(0), plans, 5).count() == 0 and M.matches(docs, plans.limit(0), 5).count() == 0


def test_symbols(spark):
    """Every kind of definition, repeats, and each part of the score."""
    text = "import x\r\ndef load(a):\n  class Loader(Base):\nexport async function fetchAll(q) {\nconst handle = async (x) => 1\nexport class Loader {\nlet n = 5\nclassy = 1\n def LOAD (b):\n"
    docs = spark.createDataFrame([(1, "src/io/load.py", text), (2, "q.md", "def loader_two(): pass"), (3, "z.md", None), (None, "n", "def load(): 1")], "id long, path string, text string")
    found = {(r["id"], r["line"], r["symbol"]) for r in Z.definitions(docs).collect()}
    assert found == {(1, 2, "load"), (1, 3, "Loader"), (1, 4, "fetchAll"), (1, 5, "handle"), (2, 1, "loader_two")}
    plans = M.query_plans(table(spark, [(7, "load with fetchAll in lib/load.py"), (8, "nothing here")]))
    words = Z.query_words(plans).where("query = 7").first()
    assert words["terms"] == ["load", "fetchall", "in", "lib", "py", "fetch", "all"] and words["names"] == ["fetchall"] and words["hints"] == ["lib/load.py"]
    best = spark.createDataFrame([(7, 2, 3.0, 1), (7, 1, 2.0, 2), (7, 3, 1.0, 3), (8, 1, 9.0, 1), (7, 2, 9.0, 61)], "query long, id long, score double, rank long")
    got = {(r["id"], r["symbol"]): r["score"] for r in Z.symbol_hits(docs, plans, best, 20).where("query = 7").collect()}
    rank, base = lambda k: 1.4 - 0.03 * k, lambda s: 0.35 * s
    want = {(2, "loader_two"): 2.8 + rank(1) + base(3), (1, "load"): 6 + 1.2 + rank(2) + base(2), (1, "Loader"): 2.8 + 1.2 + rank(2) + base(2), (1, "fetchAll"): 6 + 2.8 + 2.8 + 16 + 1.2 + rank(2) + base(2)}
    assert {k: round(v, 4) for k, v in want.items()} == got
    assert [r["symbol"] for r in Z.symbol_hits(docs, plans, best, 2).orderBy("line").collect() if r["id"] == 2] == ["loader_two"]


def test_common_features_are_scored_once_a_class(spark, monkeypatch):
    """Every query met every document that has a word of all queries."""
    r = random.Random(6)
    words = ["open", "lib", "class", "find", "m1", "m12", "c7", "red", "x/m1.py"]
    asked = table(spark, [(i, f"open x/m{i}.py and then find class C{i}, method m{i} {r.choice(words)}") for i in range(40)])
    docs = spark.createDataFrame([(i, r.choice(["x/m1.py", f"x/m{i}.py", "q"]), " ".join(r.choice(words) for _ in range(r.randint(1, 6))) + f" class c{i}") for i in range(80)], "id long, path string, text string").repartition(3)
    plans = M.query_plans(asked).cache()
    plain_rows = sorted(map(tuple, M.matches(docs, plans, 7).collect()))
    monkeypatch.setattr(M, "SHARED", 20)
    assert sorted(map(tuple, M.matches(docs, plans, 7).collect())) == plain_rows
    assert sorted(map(tuple, M.matches(docs, plans, 7, 9).collect())) == plain_rows
    full = [tuple(p) for p in plans.select("query", "plan", "kind", "weight", "text", M.query_terms(M.F.col("text")), M.exact_identifiers(M.F.col("text")), M.path_hints(M.F.col("text"))).orderBy("query", "plan").collect()]
    m = M.Matcher(full)
    entries, _ = m.scores("q", "open the lib")
    assert 0 < m.classes < len(full) / 2 and len(entries) < m.classes + 20
    batch = M.pa.RecordBatch.from_pydict({"id": list(range(500)), "path": ["q"] * 500, "text": ["open the class"] * 500})
    rows = [x for got in M._best(full, 7)(iter([batch])) for x in got.to_pylist()]
    assert {x["query"] for x in rows} == {None} and len(rows) <= 7 * m.classes
