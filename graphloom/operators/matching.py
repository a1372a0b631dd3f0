"""Text match scores: query plans, and one automaton of all their words run once over each text.

A query gives up to six plans: itself, its segments, and a bridge of the first
and the last, each with its words, identifiers and path hints.  Every distinct
word, identifier, hint and phrase is a feature with a value in a document:

* a word: 2.2 in the path, and 1.1 for each of up to eight places in the text;
* a hint: 3 in the path, or 2 if its last part is;
* a phrase of six characters or more: 2.5 in the text;
* an identifier: 4.5 in the path, 1.8 for each of up to four places, and 12,
  10, 10 or 8 where it is defined (def, class, function, const or let).

A plan's score is the sum of its features and 0.2 for a path of code; the
query's is the best of its plans' by weight.  Values are whole tenths, so sums
are exact.  Places do not overlap and need not be whole words.

All strings of a round of queries go into one automaton (goto and failure
links); a task runs it over its texts and paths.  Features that more than
``SHARED`` plans have are common: plans of a round with the same common features
and weight are a class, and a document's sum of them is made once a class.  It is
a document's score for all plans of the class but those that it shares a rarer
feature with, and never more than theirs.  So a task keeps the best documents of
each class, and of each query among those with a rarer feature; both are merged
by rank, and only then a class's best meet its queries.  A query's best by its
plans are among these, as no more documents go before one in its class, or by one
plan, than by the query's best.  Texts stay where they are, each is read once a
round.  Documents that share nothing with a plan have no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.lineage import cut

#: Queries of a round; plans that a feature must have to be common.
ROUND, SHARED = 16384, 128
#: Words that no plan looks for (fixed values).
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "how", "why", "where", "when",
    "please", "help", "code", "project", "function", "method",
    "请", "帮我", "如何", "怎么", "这个", "那个", "代码", "项目", "方法", "函数",
)
#: Weights of the plans of a query (fixed values).
WEIGHTS = {"primary": 1.0, "segment": 0.78, "bridge": 0.72}
CODE = (".py", ".ts", ".tsx", ".js", ".java")
#: What stands around an identifier where it is defined, and its value in tenths; the first that is there counts (fixed values).
DEFINITIONS = (("def {}(", 120), ("class {}", 100), ("function {}(", 100), ("const {} =", 80), ("let {} =", 80))
_WORD = r"[\p{L}\p{N}_]"
_SPLIT = rf"(?i)\s*(?:->|=>|;|；|,|，|(?<!{_WORD})(?:and|then)(?!{_WORD})|并且|然后|再|以及)\s*"
_TERM = "[a-zA-Z_][a-zA-Z0-9_]{1,}|[一-鿿]{2,}"
_HINT = r"[A-Za-z]:\\[^\s,;，；]+|[^\s,;，；]+(?:\\|/)[^\s,;，；]+|[^\s,;，；]+\.(?:py|ts|tsx|js|java|go|rs|cpp|c|cs|md)"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def query_terms(text: Column) -> Column:
    """Up to 16 distinct words of a query, lower-case, in order."""
    return F.slice(F.array_distinct(F.filter(_found(F.lower(text), _TERM), lambda w: ~w.isin(*STOPWORDS))), 1, 16)


def exact_identifiers(text: Column) -> Column:
    """Up to 16 words that look like names: with an underscore or a change of case, or of 12 characters."""
    named = F.filter(_found(text, "[A-Za-z_][A-Za-z0-9_]{3,}"), lambda w: F.contains(w, F.lit("_")) | w.rlike("[a-z][A-Z]|[A-Z][a-z]") | (F.length(w) >= 12))
    return F.slice(F.array_distinct(F.filter(F.transform(named, F.lower), lambda w: ~w.isin(*STOPWORDS))), 1, 16)


def path_hints(text: Column) -> Column:
    """What looks like a path, with slashes."""
    return F.array_distinct(F.transform(_found(text, _HINT), lambda h: F.translate(h, "\\", "/")))


def query_plans(asked: DataFrame) -> DataFrame:
    """(query, plan, kind, weight, text): up to six plans of each query (query, text), numbered from 0."""
    root = asked.select("query", F.trim("text").alias("text")).where("text <> ''")
    parts = F.array_distinct(F.filter(F.transform(F.split("text", _SPLIT), lambda s: F.trim(s)), lambda s: s != ""))
    plan = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight"), text.alias("text"))
    bridge = F.when(F.size("parts") >= 2, F.array(plan("bridge", F.concat_ws(" ", F.get("parts", F.lit(0)), F.element_at("parts", -1))))).otherwise(F.array().cast("array<struct<kind:string,weight:double,text:string>>"))
    every = root.withColumn("parts", parts).select("query", F.concat(F.array(plan("primary", F.col("text"))), F.transform("parts", lambda s: plan("segment", s)), bridge).alias("p"))
    firsts = F.filter(F.col("p"), lambda x, i: F.array_position(F.transform("p", lambda y: y["text"]), x["text"]) == i + 1)
    return every.select("query", F.posexplode(F.slice(firsts, 1, 6)).alias("plan", "p")).select("query", F.col("plan").cast("long").alias("plan"), "p.kind", "p.weight", "p.text")


class Uses:
    """The features of plans (query, plan, kind, weight, text, terms, identifiers, hints), and the classes of plans by their common ones.

    ``members`` has the plan numbers of each class, ``rare`` of each feature those of its plans if it is not common.
    """

    def __init__(self, plans: list[tuple], shared: int):
        features: dict[tuple[str, str], int] = {}
        uses: list[list[int]] = []
        of: list[list[int]] = []
        for p, (_, _, _, _, text, terms, identifiers, hints) in enumerate(plans):
            own = [("term", x) for x in terms] + [("name", x) for x in identifiers if x] + [("hint", x.lower()) for x in hints]
            own += [("phrase", text.lower())] if len(text) >= 6 else []
            of.append([features.setdefault(f, len(features)) for f in own])
            for f in of[-1]:
                if f == len(uses):
                    uses.append([])
                uses[f].append(p)
        self.features = list(features)
        classes: dict[tuple, int] = {}
        self.members: list[list[int]] = []
        for p, own in enumerate(of):
            common = sorted(f for f in own if len(uses[f]) > shared)
            c = classes.setdefault((plans[p][3], *common), len(classes)) if common else -1
            if c == len(self.members):
                self.members.append([])
            if c >= 0:
                self.members[c].append(p)
        self.rare = [u if len(u) <= shared else [] for u in uses]
        self.common: list[list[int]] = [[] for _ in uses]
        for (_, *common), c in classes.items():
            for f in common:
                self.common[f].append(c)


class Matcher:
    """The automaton of plans, and for each feature the plans that have it if it is rare, or else their classes."""

    def __init__(self, plans: list[tuple], uses: Uses | None = None):
        import ahocorasick

        uses = uses or Uses(plans, SHARED)
        self.features = uses.features
        strings: dict[str, int] = {}
        number = lambda s: strings.setdefault(s, len(strings))
        self.strings = []
        for kind, x in self.features:
            more = [d.format(x) for d, _ in DEFINITIONS] if kind == "name" else [x.rsplit("/", 1)[-1]] if kind == "hint" and x.rsplit("/", 1)[-1] else []
            self.strings.append([number(s) for s in (x, *more)])
        self.sizes = [len(s) for s in strings]
        self.of = [[] for _ in strings]
        for f, own in enumerate(self.strings):
            for s in own:
                self.of[s].append(f)
        self.automaton = ahocorasick.Automaton()
        for s, i in strings.items():
            self.automaton.add_word(s, i)
        if strings:
            self.automaton.make_automaton()
        self.plans, self.classes = len(plans), len(uses.members)
        self.rare, self.common = ([np.array(x, np.int64) for x in of] for of in (uses.rare, uses.common))
        self.of_class = np.full(len(plans), self.classes, np.int64)
        for c, own in enumerate(uses.members):
            self.of_class[own] = c

    def counts(self, text: str) -> dict[int, int]:
        """How often each string stands in a text, without overlaps of its own."""
        if not self.sizes:
            return {}
        n: dict[int, int] = {}
        ends: dict[int, int] = {}
        for end, s in self.automaton.iter(text):
            if end - self.sizes[s] >= ends.get(s, -1):
                ends[s] = end
                n[s] = n.get(s, 0) + 1
        return n

    def scores(self, path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Plans that a document (lower-case) shares a rare feature with and, numbered after all plans, classes that it shares any with; their scores in tenths."""
        here, there = self.counts(text), self.counts(path)
        live = {f for s in (*here, *there) for f in self.of[s]}
        plans, values = [], []
        total = np.zeros(self.classes + 1, np.int64)
        for f in live:
            kind, own = self.features[f][0], self.strings[f]
            n, inside = here.get(own[0], 0), own[0] in there
            if kind == "term":
                value = 22 * inside + 11 * min(n, 8)
            elif kind == "hint":
                value = 30 if inside else 20 if len(own) > 1 and own[1] in there else 0
            elif kind == "phrase":
                value = 25 * (n > 0)
            else:
                value = 45 * inside + 18 * min(n, 4) + next((v for s, (_, v) in zip(own[1:], DEFINITIONS, strict=True) if s in here), 0)
            if value:
                if len(self.common[f]):
                    total[self.common[f]] += value
                else:
                    plans.append(self.rare[f])
                    values.append(np.full(len(self.rare[f]), value))
        c = np.flatnonzero(total)  # a feature that is there has a value above 0
        p, tenths = self.plans + c, total[c]
        if plans:
            own, place = np.unique(np.concatenate(plans), return_inverse=True)
            more = np.bincount(place, np.concatenate(values)).astype(np.int64) + total[self.of_class[own]]
            p, tenths = np.concatenate([own, p]), np.concatenate([more, tenths])
        return p, tenths + 2 * path.endswith(CODE)


class Rounded:
    """Scores of tenths by a plan's weight, to four places, in a table that grows with the tenths that come."""

    def __init__(self, weights: list[float]):
        self.kinds = sorted(set(weights))
        self.kind = np.array([self.kinds.index(w) for w in weights], np.int64)
        self.table = np.zeros((len(self.kinds), 0))

    def of(self, plans: np.ndarray, tenths: np.ndarray) -> np.ndarray:
        most = int(tenths.max())
        if most >= self.table.shape[1]:
            self.table = np.array([[round(t / 10 * w, 4) for t in range(2 * most + 1)] for w in self.kinds])
        return self.table[self.kind[plans], tenths]


#: What tasks find: rows of a query, or of a class.
_FOUND = "query long, plan long, kind string, class long, id long, score double, size long"


def _best(plans: list[tuple], top: int, base: int = 0):
    """A task's best rows for each query and, numbered from ``base`` on, each class."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    shared = SHARED  # as the driver has it
    queries = {q: i for i, q in enumerate(dict.fromkeys(p[0] for p in plans))}
    of, weight = [queries[p[0]] for p in plans], [p[3] for p in plans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = Uses(plans, shared)
        # Classes stand after the queries, as plans of their own.
        lists = len(queries) + len(uses.members)
        matcher, rounded = Matcher(plans, uses), Rounded(weight + [weight[m[0]] for m in uses.members])
        query = np.concatenate([np.array(of, np.int64), np.arange(len(queries), lists)])
        del uses
        best: list[list[tuple]] = [[] for _ in range(lists)]
        # What a query's last row has, once it has ``top``: only better documents are looked at one by one.
        floor, size, last = np.full(lists, -1.0), np.zeros(lists, np.int64), np.zeros(lists, np.int64)
        for batch in batches:
            for i, path, text in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "text")), strict=True):
                p, tenths = matcher.scores(path, text)
                if not len(p):
                    continue
                q, score = query[p], rounded.of(p, tenths)
                order = np.lexsort((p, -score, q)) if np.any(q[1:] < q[:-1]) else None
                if order is not None:
                    p, q, score = p[order], q[order], score[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                top_score, asked = np.maximum.reduceat(score, first), q[first]
                n = len(path)
                ahead = (top_score > floor[asked]) | ((top_score == floor[asked]) & ((n < size[asked]) | ((n == size[asked]) & (i < last[asked]))))
                ends = np.append(first[1:], len(p))
                for k in np.flatnonzero(ahead & (top_score > 0)).tolist():
                    a, x = asked[k], top_score[k]
                    plan = int(p[first[k] + int(np.argmax(score[first[k] : ends[k]] == x))])  # of equal plans the first
                    row = (float(x), -n, -i, -plan)
                    if len(best[a]) < top:
                        heapq.heappush(best[a], row)
                    elif row > best[a][0]:
                        heapq.heapreplace(best[a], row)
                    if len(best[a]) == top:
                        floor[a], size[a], last[a] = best[a][0][0], -best[a][0][1], -best[a][0][2]
        whole = [(*p[:3], None) for p in plans] + [(None, None, None, base + c) for c in range(lists - len(queries))]
        for a in range(0, lists, 1024):
            rows = [(*whole[-x], -i, s, -z) for q in best[a : a + 1024] for s, z, i, x in q]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def matches(docs: DataFrame, plans: DataFrame, top: int, round_queries: int = ROUND) -> DataFrame:
    """(query, id, plan, kind, score, rank): the ``top`` documents (id, path, text) of each query by its best plan.

    Equal scores go to the shorter path, then the smaller id; null texts and
    paths are empty, rows without an id take no part.
    """
    own = docs.where("id is not null").select("id", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("path", "text")])
    full = plans.select("query", "plan", "kind", "weight", "text", query_terms(F.col("text")).alias("terms"), exact_identifiers(F.col("text")).alias("identifiers"), path_hints(F.col("text")).alias("hints"))
    rounds = max(1, -(-plans.select("query").distinct().count() // round_queries))
    near = members = None
    classes = 0
    for r in range(rounds):
        part = [tuple(p) for p in full.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).orderBy("query", "plan").collect()]  # a round's plans
        found = own.mapInArrow(_best(part, top, classes), _FOUND)
        rows = [(classes + c, *part[p][:3]) for c, m in enumerate(Uses(part, SHARED).members) for p in m]
        classes = max([classes, *[x[0] + 1 for x in rows]])
        held = cut(docs.sparkSession.createDataFrame(pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["class", "query", "plan", "kind"])), "members")
        near, members = (found, held) if near is None else (near.unionByName(found), members.unionByName(held))
    near = cut(near, "near")
    ahead = [F.desc("score"), F.col("size"), F.col("id")]
    shared = near.where("class is not null").withColumn("n", F.row_number().over(W.partitionBy("class").orderBy(*ahead))).where(F.col("n") <= top)
    shared = shared.select("class", "id", "score", "size").join(members, "class")
    every = near.where("class is null").drop("class").unionByName(shared.drop("class"))
    best = every.groupBy("query", "id").agg(F.max(F.struct("score", -F.col("plan"), "plan", "kind", "size")).alias("x")).select("query", "id", "x.plan", "x.kind", "x.score", "x.size")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*ahead)).cast("long")).where(F.col("rank") <= top).drop("size")
