"""Further queries: resolution joins, sets, windows, search variants, communities, views and reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import text as X
from graphloom.lineage import cut
from graphloom.operators import alike as K
from graphloom.operators import communities as C
from graphloom.operators import graph as G
from graphloom.operators import imports as I
from graphloom.operators import ranking as R
from graphloom.operators import search as S
from graphloom.operators import traces as T
from graphloom.operators import vectors as V
from graphloom.operators import wordindex as N
from graphloom.plans.book import Tables, query
from graphloom.plans.evidence import _METHODS, g_paths_intermediate, similar_methods
from graphloom.plans.graphs import _BACK, _FWD, CALLS, CM, FLOW, _calls, g_paths_entry_forward, g_paths_leaf_to_entry
from graphloom.plans.projects import DOMAINS, _domain, _first
from graphloom.plans.relational import _SIDES, with_partitions
from graphloom.plans.retrieval import _BM25, _JAC, _RRF, _TERMS, _TOK, _asked, _questions, _terms
from graphloom.sources import bindings as B
from graphloom.sources.bindings import with_

_flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")

# ---- joins ----------------------------------------------------------------------

_IMPORTS = CALLS + r""", files AS (SELECT DISTINCT 'src/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.py' AS path FROM part),
asked AS (
  SELECT DISTINCT 'src/' || replace(a.p_brand, '#', '') || '/' || replace(a.p_name, ' ', '_') || '.py' AS file, replace(a.p_brand, '#', '') AS folder,
    CASE b.p_size % 4 WHEN 0 THEN replace(b.p_brand, '#', '') WHEN 1 THEN replace(b.p_name, ' ', '_') WHEN 2 THEN string_split(b.p_name, ' ')[2] ELSE '' END AS module,
    CASE WHEN b.p_size % 4 = 3 THEN 'My_' || replace(b.p_name, ' ', '_') || CASE WHEN b.p_size % 8 = 3 THEN '_x' ELSE '' END ELSE replace(b.p_name, ' ', '_') END AS name, b.p_size % 4 = 0 AS relative, (b.p_size % 4 = 0)::INT AS up
  FROM calls JOIN part a ON caller = a.p_partkey JOIN part b ON callee = b.p_partkey),
m AS (SELECT *, CASE WHEN module = '' THEN name ELSE module END AS needle FROM asked),
inside AS (SELECT needle, min(path) AS path FROM (SELECT DISTINCT needle FROM m), files WHERE contains(path, needle) GROUP BY needle),
stems AS (SELECT lower(regexp_extract(path, '([^/]*)\.py$', 1)) AS stem, min(path) AS path FROM files GROUP BY ALL),
fuzzy AS (SELECT low, arg_min(path, (abs(length(low) - length(stem)), path)) AS path FROM (SELECT DISTINCT lower(name) AS low FROM m), stems WHERE contains(stem, low) OR contains(low, stem) GROUP BY low),
found AS (
  SELECT m.file, m.module, m.name, coalesce(r.path, l.path, i.path, f.path) AS target, CASE WHEN r.path IS NOT NULL THEN 0.95 WHEN l.path IS NOT NULL THEN 0.9 WHEN i.path IS NOT NULL THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence
  FROM m LEFT JOIN files r ON relative AND r.path = 'src/' || module || '/' || name || '.py' LEFT JOIN files l ON l.path = 'src/' || folder || '/' || needle || '.py' LEFT JOIN inside i ON i.needle = m.needle LEFT JOIN fuzzy f ON f.low = lower(name)
  WHERE coalesce(r.path, l.path, i.path, f.path) IS NOT NULL)"""


def _imports(t: Tables) -> DataFrame:
    """(file, module, name, target, confidence): what the modules of all calls import, resolved.

    A part's module stands in the folder of its brand; how it is imported
    follows the size: by a path, by its name, by its last word, or renamed.
    """
    folder, plain = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.concat(F.lit("src/"), folder, F.lit("/"), plain, F.lit(".py"))
    kind = F.col("p_size") % 4
    module = F.when(kind == 0, folder).when(kind == 1, plain).when(kind == 2, F.get(F.split("p_name", " "), F.lit(1))).otherwise("")
    name = F.when(kind == 3, F.concat(F.lit("My_"), plain, F.when(F.col("p_size") % 8 == 3, "_x").otherwise(""))).otherwise(plain)
    callee = t.part.select(F.col("p_partkey").alias("callee"), module.alias("module"), name.alias("name"), (kind == 0).alias("relative"), (kind == 0).cast("int").alias("up"))
    asked = B.calls(t.lineitem).join(t.part.select(F.col("p_partkey").alias("caller"), path.alias("file")), "caller").join(callee, "callee")
    return I.resolved(t.part.select(path.alias("path")), asked).select("file", "module", "name", "target", "confidence")


@query("join_import_resolve", _IMPORTS + " SELECT * FROM found")
def join_import_resolve(t):
    return _imports(t)


_NEAR = ", near AS (SELECT source, lang, doc_id AS other FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 3)"


@query(
    "join_graph_context",
    _TERMS + _BM25 + _NEAR + ", hit AS (SELECT query, id, source, lang FROM bm_ranked JOIN documents ON id = doc_id WHERE rank <= 3), two AS (SELECT query, id, other FROM hit JOIN near USING (source, lang) WHERE other <> id QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY other) <= 2)"
    " SELECT query, id, 'community' AS kind, coalesce(source, '') AS value FROM hit UNION ALL SELECT query, id, 'neighbour', other::VARCHAR FROM two UNION ALL SELECT query, id, 'none', '' FROM hit h WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.query = h.query AND t.id = h.id)",
)
def join_graph_context(t):
    """Each hit's community and two neighbours of its kind, or a row that says there are none."""
    d = t.documents.select("doc_id", "source", "lang")
    hit = cut(S.bm25(_terms(t), _asked(t), 3, t.documents.count()).join(d, F.col("id") == F.col("doc_id")).select("query", "id", "source", "lang"), "hits")
    first = W.partitionBy("source", "lang").orderBy("doc_id")
    near = d.withColumn("n", F.row_number().over(first)).where("n <= 3").select("source", "lang", F.col("doc_id").alias("other"))
    two = hit.join(near, ["source", "lang"]).where("other <> id").withColumn("n", F.row_number().over(W.partitionBy("query", "id").orderBy("other"))).where("n <= 2")
    out = hit.select("query", "id", F.lit("community").alias("kind"), F.coalesce("source", F.lit("")).alias("value"))
    out = out.union(two.select("query", "id", F.lit("neighbour"), F.col("other").cast("string")))
    return out.union(hit.join(two, ["query", "id"], "left_anti").select("query", "id", F.lit("none"), F.lit("")))


@query("join_seed_nodes", "WITH asked AS (SELECT p_partkey AS ask, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 20 = 0), nodes AS (SELECT p_partkey AS node, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) SELECT ask, node, count(*) AS hits FROM asked JOIN nodes USING (w) WHERE ask <> node GROUP BY ask, node QUALIFY row_number() OVER (PARTITION BY ask ORDER BY count(*) DESC, node) <= 6")
def join_seed_nodes(t):
    """The six nodes that have most of the words of each asked name, by the classes of equal names."""
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    hits = F.size(F.filter("n", lambda w: F.array_contains("m", w)))
    return K.best(p, p.where("id % 20 = 0"), "p_name", [], {"hits": hits}, F.col("hits"), 1, 6).select("ask", F.col("id").alias("node"), F.col("score").cast("long").alias("hits"))


@query("q_similar_methods", _METHODS + " SELECT a AS method, b AS other, score FROM pairs WHERE score >= 0.3 UNION ALL SELECT b, a, score FROM pairs WHERE score >= 0.3")
def q_similar_methods(t):
    """The similar methods of each, in both directions."""
    way = lambda a, b: F.struct(F.col(a).alias("method"), F.col(b).alias("other"))
    return similar_methods(t).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x"), "score").select("x.method", "x.other", "score")


@query("q_entity_resolve", "WITH alias AS (SELECT p_partkey::VARCHAR AS alias, p_partkey AS id, 1 AS p FROM part UNION ALL SELECT p_name || '@' || p_brand, p_partkey, 2 FROM part UNION ALL SELECT p_name, p_partkey, 3 FROM part) SELECT alias, id, p::INT AS priority FROM alias QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, id) = 1")
def q_entity_resolve(t):
    p = t.part
    alias = p.select(F.col("p_partkey").cast("string").alias("alias"), F.col("p_partkey").alias("id"), F.lit(1).alias("priority"))
    alias = alias.union(p.select(F.concat_ws("@", "p_name", "p_brand"), "p_partkey", F.lit(2))).union(p.select("p_name", "p_partkey", F.lit(3)))
    best = alias.groupBy("alias").agg(F.min(F.struct("priority", "id")).alias("x"))
    return best.select("alias", "x.id", "x.priority")


@query("q_partition_param_trace", CM + "SELECT a.part, callee, p_type AS param FROM calls JOIN member a ON caller = a.node JOIN member b ON callee = b.node JOIN part ON callee = p_partkey WHERE a.part = b.part")
def q_partition_param_trace(t):
    e = with_partitions(B.calls(t.lineitem), B.membership(t.part)).where("p1 = p2")
    return e.join(t.part.select(F.col("p_partkey").alias("callee"), F.col("p_type").alias("param")), "callee").select(F.col("p1").alias("part"), "callee", "param")


@query("q_partition_return_trace", CM + "SELECT a.part, caller, CASE WHEN p_size > 40 THEN p_type ELSE 'result' END AS label FROM calls JOIN member a ON caller = a.node JOIN member b ON callee = b.node JOIN part ON callee = p_partkey WHERE a.part = b.part")
def q_partition_return_trace(t):
    e = with_partitions(B.calls(t.lineitem), B.membership(t.part)).where("p1 = p2")
    label = t.part.select(F.col("p_partkey").alias("callee"), F.when(F.col("p_size") > 40, F.col("p_type")).otherwise("result").alias("label"))
    return e.join(label, "callee").select(F.col("p1").alias("part"), "caller", "label")


# ---- sets and windows ---------------------------------------------------------------

_TRACES = "WITH step AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), trace AS (SELECT DISTINCT path FROM (SELECT list(l_partkey ORDER BY l_partkey) AS path FROM step GROUP BY l_orderkey UNION ALL SELECT list(l_partkey ORDER BY l_partkey)[1:2] FROM step GROUP BY l_orderkey))"


@query("set_dedup_traces", _TRACES + ", places AS (SELECT path AS long, unnest(path) AS x, unnest(range(1, len(path) + 1)) AS i FROM trace) SELECT path FROM trace t WHERE NOT EXISTS (SELECT 1 FROM places WHERE x = t.path[1] AND len(long) > len(t.path) AND long[i:i + len(t.path) - 1] = t.path)")
def set_dedup_traces(t):
    """Traces that are no part of a longer one."""
    step = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    whole = cut(step.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("path")).select("path"), "orders")
    return T.longest(whole.union(whole.select(F.slice("path", 1, 2))))


#: Phrases that open a new topic (fixed values).
CUES = ("new topic", "another question", "by the way", "next")


def _units(t: Tables) -> DataFrame:
    """A unit ends at a topic shift, at a cue and after ten messages; between shifts the tens are counted."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("s"), F.lower("text").rlike("|".join(CUES)).alias("cue"))
    shift = F.size(F.array_intersect("s", F.lag("s").over(w))) < 2
    c = c.withColumn("stretch", F.sum(_flag(shift | F.col("cue"))).over(w))
    n = F.row_number().over(W.partitionBy("conv_id", "stretch").orderBy("turn")) - 1
    c = c.withColumn("opens", (n % 10 == 0).cast("int"))
    return c.select("conv_id", "turn", F.sum("opens").over(w).alias("unit"))


_UNITS = f"WITH c AS (SELECT conv_id, turn, {_TOK.format(t='text')} AS s, regexp_matches(lower(text), '{'|'.join(CUES)}') AS cue FROM conversations), l AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c), st AS (SELECT *, sum(coalesce(len(list_intersect(s, p)) < 2 OR cue, cue, false)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS stretch FROM l), o AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn) - 1) % 10 = 0)::INT AS opens FROM st), u AS (SELECT conv_id, turn, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS unit FROM o)"


@query("win_context_units", _UNITS + " SELECT conv_id, turn, unit FROM u")
def win_context_units(t):
    return _units(t)


@query("st_topic_units", _UNITS + " SELECT conv_id, unit, min(turn) AS first, count(*) AS messages FROM u GROUP BY ALL")
def st_topic_units(t):
    return _units(t).groupBy("conv_id", "unit").agg(F.min("turn").alias("first"), F.count("*").alias("messages"))


@query("q_memory_context", _UNITS + ", n AS (SELECT conv_id, max(unit) AS now FROM u GROUP BY 1) SELECT conv_id, turn, CASE WHEN unit = now THEN 'current' ELSE 'retrieved' END AS kind FROM u JOIN n USING (conv_id) WHERE unit >= now - 2")
def q_memory_context(t):
    """The current unit of each conversation and the two before it."""
    u = _units(t).withColumn("now", F.max("unit").over(W.partitionBy("conv_id")))
    return u.where("unit >= now - 2").select("conv_id", "turn", F.when(F.col("unit") == F.col("now"), "current").otherwise("retrieved").alias("kind"))


# ---- graphs -------------------------------------------------------------------------


@query("g_roots_leaves", CM + ", e AS (SELECT a.part, caller, callee FROM calls JOIN member a ON caller = a.node JOIN member b ON callee = b.node WHERE a.part = b.part) SELECT part, node, node NOT IN (SELECT callee FROM e) AS root, node NOT IN (SELECT caller FROM e) AS leaf FROM member WHERE node NOT IN (SELECT callee FROM e) OR node NOT IN (SELECT caller FROM e)")
def g_roots_leaves(t):
    """Nodes that no node of their partition calls, or that call none."""
    m = B.membership(t.part)
    e = cut(with_partitions(B.calls(t.lineitem), m).where("p1 = p2").select("caller", "callee"), "inner-edges")
    out, into = (e.select(F.col(c).alias("node")).distinct().withColumn(f"_{c}", F.lit(True)) for c in ("caller", "callee"))
    x = m.join(out, "node", "left").join(into, "node", "left").select("part", "node", F.col("_callee").isNull().alias("root"), F.col("_caller").isNull().alias("leaf"))
    return x.where("root or leaf")


_MID = "mid AS (SELECT callee AS node FROM flow WHERE callee IN (SELECT caller FROM flow) ORDER BY 1 LIMIT 30), m(path) AS (SELECT [node] FROM mid UNION ALL SELECT list_append(path, callee) FROM m JOIN flow ON path[-1] = caller WHERE len(path) < 10)"


@query("g_paths_enhanced", FLOW + f", {_FWD.format(n=15)}, {_BACK.replace('p(path)', 'b(path)').replace('FROM p ', 'FROM b ')}, {_MID} SELECT DISTINCT path FROM (SELECT path FROM p WHERE len(path) = 15 OR path[-1] NOT IN (SELECT caller FROM flow) UNION ALL SELECT path FROM b UNION ALL SELECT path FROM m WHERE len(path) = 10 OR path[-1] NOT IN (SELECT caller FROM flow))")
def g_paths_enhanced(t):
    """Paths from entries, from leaves and through the middle, each once."""
    return g_paths_entry_forward(t).union(g_paths_leaf_to_entry(t)).union(g_paths_intermediate(t)).distinct()


@query("q_structural_paths", FLOW + "SELECT part, [caller, callee] AS path FROM flow")
def q_structural_paths(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")
    return x.select("part", F.array("a", "b").alias("path"))


@query("g_community_louvain")
def g_community_louvain(t):
    """Louvain communities of all calls."""
    return C.louvain(_calls(t)).members


@query("g_community_leiden")
def g_community_leiden(t):
    """Leiden communities of all calls, each connected by its own calls."""
    return C.detected(_calls(t), "leiden").members


@query("g_community_shadow")
def g_community_shadow(t):
    """The 200 nodes of most calls, their communities with a label, size and cohesion."""
    e = _calls(t)
    both = e.union(e.select("callee", "caller")).toDF("node", "other")
    top = cut(both.groupBy("node").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "node").limit(200).select("node"), "sample")
    inner = cut(e.join(top.toDF("caller"), "caller", "left_semi").join(top.toDF("callee"), "callee", "left_semi"), "sampled")
    member = C.louvain(inner).members
    sides = inner.join(member.toDF("caller", "a"), "caller").join(member.toDF("callee", "b"), "callee")
    calls = sides.select("a", (F.col("a") == F.col("b")).cast("int").alias("k")).union(sides.where("a <> b").select("b", F.lit(0))).groupBy(F.col("a").alias("label")).agg(F.sum("k").alias("own"), F.count("*").alias("all"))
    named = member.join(t.part.select(F.col("p_partkey").alias("node"), "p_brand"), "node").groupBy("label", "p_brand").agg(F.count("*").alias("n"))
    title = named.groupBy("label").agg(F.max_by("p_brand", F.struct("n", "p_brand")).alias("title"), F.sum("n").alias("size"))
    return title.join(calls, "label", "left").select("label", "title", "size", F.coalesce(F.round(F.col("own") / F.col("all"), 6), F.lit(0.0)).alias("cohesion"))


@query("g_modularity_iterate")
def g_modularity_iterate(t):
    """Modularity of communities of all calls, level by level, until it gains less than a tenth or three rounds are done."""
    rows: list[tuple[int, float]] = []
    for k, q in enumerate(C.louvain(_calls(t), levels=3).quality, 1):
        rows.append((k, round(q, 6)))
        if k > 1 and rows[-1][1] - rows[-2][1] < 0.1:
            break
    return t.spark.createDataFrame(rows, "round int, modularity double")


@query("edge_widths", CM + f", {_SIDES}, w AS (SELECT p1, count(*) AS n FROM sides WHERE p1 <> p2 GROUP BY ALL) SELECT p1, round(10 + 2.0 * n, 4)::DOUBLE AS size, round(1 + 4.0 * n / (SELECT max(n) FROM w), 6)::DOUBLE AS width FROM w")
def edge_widths(t):
    """Sizes of partitions by their outgoing calls, and widths by their share of the most."""
    w = cut(with_partitions(_calls(t), B.membership(t.part)).where("p1 <> p2").groupBy("p1").agg(F.count("*").alias("n")), "widths")
    return w.join(F.broadcast(w.agg(F.max("n").alias("m")))).select("p1", F.round(10 + 2.0 * F.col("n"), 4).alias("size"), F.round(1 + 4.0 * F.col("n") / F.col("m"), 6).alias("width"))


@query("q_hypergraph_view", CALLS + "SELECT 'edge' AS kind, caller AS source, callee AS target, 1::BIGINT AS weight FROM calls UNION ALL SELECT 'hyperedge', caller, NULL, count(*) FROM calls GROUP BY caller HAVING count(*) >= 3")
def q_hypergraph_view(t):
    e = B.calls(t.lineitem)
    wide = e.groupBy("caller").agg(F.count("*").alias("weight")).where("weight >= 3")
    return e.select(F.lit("edge").alias("kind"), F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit(1).cast("long").alias("weight")).union(wide.select(F.lit("hyperedge"), "caller", F.lit(None).cast("long"), "weight"))


@query("q_callgraph_view", CM + "SELECT a.part, caller, callee, CASE WHEN a.part = b.part THEN 'internal' ELSE 'external' END AS kind FROM calls JOIN member a ON caller = a.node JOIN member b ON callee = b.node")
def q_callgraph_view(t):
    return with_partitions(B.calls(t.lineitem), B.membership(t.part)).select(F.col("p1").alias("part"), "caller", "callee", F.when(F.col("p1") == F.col("p2"), "internal").otherwise("external").alias("kind"))


_VIEWS = with_("calls", "location") + "SELECT 'call' AS view, count(*) AS edges FROM calls UNION ALL SELECT 'cross_file', count(*) FROM calls JOIN location a ON caller = a.node JOIN location b ON callee = b.node WHERE a.file <> b.file UNION ALL SELECT 'field', count(*) FROM part"


@query("q_views", _VIEWS + " UNION ALL SELECT 'complete', (SELECT count(*) FROM calls) + (SELECT count(*) FROM part)")
def q_views(t):
    """Edges of the call, cross-file, field and complete views."""
    e, at = _calls(t), B.location(t.lineitem)
    cross = e.join(at.toDF("caller", "fa"), "caller").join(at.toDF("callee", "fb"), "callee").where("fa <> fb").select(F.lit("cross_file").alias("view"))
    call, field = e.select(F.lit("call").alias("view")), t.part.select(F.lit("field").alias("view"))
    whole = e.select(F.lit("complete").alias("view")).union(t.part.select(F.lit("complete")))
    return call.union(cross).union(field).union(whole).groupBy("view").agg(F.count("*").alias("edges"))


_KG = with_("calls", "extends") + "SELECT kind, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT 'calls' AS kind, caller::VARCHAR AS source FROM calls UNION ALL SELECT 'extends', child FROM extends UNION ALL SELECT 'contains', p_brand FROM part) GROUP BY kind"


def _knowledge(t: Tables) -> DataFrame:
    e = B.calls(t.lineitem).select(F.lit("calls").alias("kind"), F.col("caller").cast("string").alias("source"), F.col("callee").cast("string").alias("target"))
    up = B.extends(t.region, t.nation, t.customer).select(F.lit("extends"), "child", "parent")
    return e.union(up).union(t.part.select(F.lit("contains"), "p_brand", F.col("p_partkey").cast("string")))


@query("q_kg_from_report", _KG)
def q_kg_from_report(t):
    return _knowledge(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("q_graph_builder", with_("calls", "extends") + "SELECT caller::VARCHAR AS source, callee::VARCHAR AS target, 'calls' AS kind, 0.85::DOUBLE AS confidence FROM calls UNION ALL SELECT child, parent, 'extends', 0.95 FROM extends UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'contains', 1.0 FROM part")
def q_graph_builder(t):
    how = F.when(F.col("kind") == "calls", 0.85).when(F.col("kind") == "extends", 0.95).otherwise(1.0)
    return _knowledge(t).select("source", "target", "kind", how.alias("confidence"))


@query("q_io_graph_heuristic", "SELECT l_orderkey, l_partkey AS node, lead(l_partkey) OVER w AS next, CASE WHEN lag(l_partkey) OVER w IS NULL THEN 'input' WHEN lead(l_partkey) OVER w IS NULL THEN 'output' ELSE 'step' END AS kind FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)")
def q_io_graph_heuristic(t):
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")
    x = t.lineitem.select("l_orderkey", "l_partkey").distinct().withColumns({"next": F.lead("l_partkey").over(w), "last": F.lag("l_partkey").over(w)})
    return x.select("l_orderkey", F.col("l_partkey").alias("node"), "next", F.when(F.col("last").isNull(), "input").when(F.col("next").isNull(), "output").otherwise("step").alias("kind"))


@query("q_io_summary", CALLS + "SELECT node, sum(i)::BIGINT AS inputs, sum(o)::BIGINT AS outputs FROM (SELECT callee AS node, 1 AS i, 0 AS o FROM calls UNION ALL SELECT caller, 0, 1 FROM calls) GROUP BY node")
def q_io_summary(t):
    e = B.calls(t.lineitem)
    x = e.select(F.col("callee").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("caller", F.lit(0), F.lit(1)))
    return x.groupBy("node").agg(F.sum("i").alias("inputs"), F.sum("o").alias("outputs"))


@query("q_constraints", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'must_hold' ELSE 'may_hold' END AS rule, p_size >= 10 AND p_retailprice < 950 AS strict FROM part")
def q_constraints(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 25, "must_hold").otherwise("may_hold").alias("rule"), ((F.col("p_size") >= 10) & (F.col("p_retailprice") < 950)).alias("strict"))


@query("q_path_semantics", f"SELECT l_orderkey, arg_min(p_name, (l_linenumber, l_partkey)) AS label, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS keywords, {_domain('arg_min(p_name, (l_linenumber, l_partkey))')} AS domain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def q_path_semantics(t):
    """The label, keywords and domain of every path."""
    at = F.struct("l_linenumber", "l_partkey")
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min_by("p_name", at).alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))).alias("keywords"))
    return x.select("l_orderkey", "label", "keywords", _first(F.col("label"), DOMAINS).alias("domain"))


@query("q_folder_nodes", "SELECT p_brand AS part, string_split(p_name, ' ')[1] AS folder, count(*) AS defs, count(DISTINCT p_type) AS classes FROM part GROUP BY ALL")
def q_folder_nodes(t):
    return t.part.groupBy(F.col("p_brand").alias("part"), F.split("p_name", " ")[0].alias("folder")).agg(F.count("*").alias("defs"), F.count_distinct("p_type").alias("classes"))


@query("q_partition_heuristic", f"SELECT {_domain('p_name')} AS part, count(*) AS members, min(p_partkey) AS first FROM part GROUP BY 1")
def q_partition_heuristic(t):
    return t.part.groupBy(_first(F.col("p_name"), DOMAINS).alias("part")).agg(F.count("*").alias("members"), F.min("p_partkey").alias("first"))


@query("q_call_chain_best", "WITH step AS (SELECT o_custkey, l_orderkey, l_partkey, p_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), chain AS (SELECT o_custkey, l_orderkey, 10 * sum((p_size > 25)::INT) + least(6, count(*)) AS score FROM step GROUP BY ALL) SELECT o_custkey, arg_max(l_orderkey, (score, -l_orderkey)) AS chain, max(score)::BIGINT AS score FROM chain GROUP BY 1")
def q_call_chain_best(t):
    """Of every customer's chains the one with most that is meaningful."""
    step = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg((10 * F.sum((F.col("p_size") > 25).cast("int")) + F.least(F.lit(6), F.count("*"))).alias("score"))
    x = step.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_custkey").agg(F.max_by("l_orderkey", F.struct("score", -F.col("l_orderkey"))).alias("chain"), F.max("score").alias("score"))


@query("q_chain_quality", "SELECT round(avg((n > 0)::INT), 6)::DOUBLE AS presence, round(avg((n >= 3)::INT), 6)::DOUBLE AS structure, round(avg(coalesce(first = 1, false)::INT), 6)::DOUBLE AS anchored FROM (SELECT o_orderkey, count(l_partkey) AS n, min(l_linenumber) AS first FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def q_chain_quality(t):
    x = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_partkey").alias("n"), F.min("l_linenumber").alias("first"))
    rate = lambda c: F.round(F.avg(_flag(c)), 6)
    return x.agg(rate(F.col("n") > 0).alias("presence"), rate(F.col("n") >= 3).alias("structure"), rate(F.col("first") == 1).alias("anchored"))


@query("q_context_score", "SELECT user_id, round(0.5 * least(1.0, count(*) / 100.0) + 0.3 * avg((event_type = 'view')::INT) + 0.2 * avg((value > 10)::INT), 6)::DOUBLE AS score, CASE WHEN avg((event_type = 'view')::INT) > avg((event_type = 'click')::INT) THEN 'A' ELSE 'B' END AS verdict FROM events GROUP BY user_id")
def q_context_score(t):
    rate = lambda c: F.avg(_flag(c))
    view, click = (rate(F.col("event_type") == k) for k in ("view", "click"))
    score = 0.5 * F.least(F.lit(1.0), F.count("*") / 100.0) + 0.3 * view + 0.2 * rate(F.col("value") > 10)
    return t.events.groupBy("user_id").agg(F.round(score, 6).alias("score"), F.when(view > click, "A").otherwise("B").alias("verdict"))


@query("q_hierarchy_evidence", FLOW + "SELECT part, caller AS node, 0 AS place, 'entry' AS kind FROM flow WHERE caller NOT IN (SELECT callee FROM flow) UNION ALL SELECT part, callee, 1, 'step' FROM flow")
def q_hierarchy_evidence(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("node"), F.row_number().over(w).alias("n"), F.lead("o_orderkey").over(w).alias("next"))
    x = x.where("n > 1 or next is not null")
    return x.select("part", "node", (F.col("n") > 1).cast("int").alias("place"), F.when(F.col("n") > 1, "step").otherwise("entry").alias("kind"))


@query("q_progress_pct", "SELECT o_custkey, round(100.0 * sum((o_orderstatus = 'F')::INT) / count(*), 4)::DOUBLE AS pct FROM orders GROUP BY 1")
def q_progress_pct(t):
    return t.orders.groupBy("o_custkey").agg(F.round(100.0 * F.sum(_flag(F.col("o_orderstatus") == "F")) / F.count("*"), 4).alias("pct"))


@query("st_progress", "SELECT user_id, event_id, CASE WHEN p >= 96 THEN 'done' WHEN p >= 90 THEN 'evidence' WHEN p >= 80 THEN 'paths' WHEN p >= 55 THEN 'graph' ELSE 'scan' END AS stage FROM (SELECT user_id, event_id, 100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id) AS p FROM events)")
def st_progress(t):
    """The stage that each event of a session reaches, by the published points."""
    w = W.partitionBy("user_id")
    p = 100.0 * F.row_number().over(w.orderBy("ts", "event_id")) / F.count("*").over(w)
    x = t.events.select("user_id", "event_id", p.alias("p"))
    stage = functools.reduce(lambda c, s: c.when(F.col("p") >= s[0], s[1]), ((90, "evidence"), (80, "paths"), (55, "graph")), F.when(F.col("p") >= 96, "done"))
    return x.select("user_id", "event_id", stage.otherwise("scan").alias("stage"))


@query("st_sse_tail", with_("log") + "SELECT key, seq, CASE WHEN seq = 1 THEN 'bootstrap' WHEN seq = max(seq) OVER (PARTITION BY key) THEN 'stream_end' ELSE 'event' END AS frame, 'id: ' || seq || chr(10) || 'event: ' || type || chr(10) || chr(10) AS text FROM log")
def st_sse_tail(t):
    """The frames of every feed: the first opens it, the last ends it."""
    log = B.event_log(t.events)
    last = F.max("seq").over(W.partitionBy("key"))
    frame = F.when(F.col("seq") == 1, "bootstrap").when(F.col("seq") == last, "stream_end").otherwise("event")
    return log.select("key", "seq", frame.alias("frame"), F.format_string("id: %d\nevent: %s\n\n", "seq", "type").alias("text"))


@query("sink_markdown", "SELECT p_brand, '| ' || p_brand || ' | ' || count(*) || ' | ' || max(p_size) || ' |' AS line FROM part GROUP BY p_brand")
def sink_markdown(t):
    x = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("m"))
    return x.select("p_brand", F.format_string("| %s | %d | %d |", "p_brand", "n", "m").alias("line"))


# ---- search ---------------------------------------------------------------------------


@query("s_symbol_terms", r"SELECT page_id, list_slice(list_distinct_keep(list_filter(string_split(lower(regexp_replace(regexp_replace(url, '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)), 1, 24) AS terms FROM pages".replace("list_distinct_keep(", "(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT ").replace(", lambda w: length(w) > 1)), 1, 24)", ", lambda w: length(w) > 1) AS x)) GROUP BY w)), 1, 24)"))
def s_symbol_terms(t):
    """Dotted, underscored and camel parts, at most 24."""
    parted = F.lower(F.regexp_replace(F.regexp_replace("url", "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " "))
    return t.pages.select("page_id", F.slice(F.array_distinct(F.filter(F.split(parted, " "), lambda w: F.length(w) > 1)), 1, 24).alias("terms"))


_INDEX = "list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '" + X.INDEX_BREAKS.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(map(repr, X.INDEX_STOPWORDS)) + "))"
#: DuckDB counts edits in bytes: each accented letter of the texts (lower-case) becomes a capital.
_BYTES = "translate({t}, 'àâäáãçéèêëíìîïñóòôöõúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_FUZZY = f"""WITH fields AS (SELECT doc_id AS id, 'content' AS field, 1.0::DOUBLE AS boost, {_INDEX.format(t='text')} AS w FROM documents UNION ALL SELECT doc_id, 'name', 2.0, {_INDEX.format(t="split_part(text, chr(10), 1)")} FROM documents),
size AS (SELECT field, sum(len(list_distinct(w))) / (SELECT count(*) FROM documents) AS mean FROM fields GROUP BY field),
post AS (SELECT id, field, boost, n, term, count(*) AS tf FROM (SELECT id, field, boost, len(list_distinct(w)) AS n, unnest(w) AS term FROM fields) GROUP BY ALL),
idf AS (SELECT field, term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY field, term),
asked AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({_INDEX.format(t='text')}) AS term FROM benchmark) GROUP BY ALL),
vocab AS (SELECT found, {_BYTES.format(t='found')} AS f FROM (SELECT DISTINCT term AS found FROM post)), first AS (SELECT term, least(round(0.2 * length(term)), 6) AS most, {_BYTES.format(t='term')} AS t FROM (SELECT DISTINCT term FROM asked)),
pair AS (SELECT term, found, CASE WHEN starts_with(found, term) THEN -1 ELSE levenshtein(t, f) END AS far FROM first, vocab WHERE starts_with(found, term) OR (abs(length(term) - length(found)) <= most AND levenshtein(t, f) <= most)),
wide AS (SELECT term, found, CASE WHEN term = found THEN 1.0::DOUBLE WHEN far < 0 THEN 0.375 * length(found) / (length(found) + 0.3 * (length(found) - length(term))) ELSE 0.45 * length(found) / (length(found) + far) END AS weight FROM pair),
hit AS (SELECT id, p.term AS found, sum(boost * idf * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * n / mean)))) AS part FROM post p JOIN idf i ON p.term = i.term AND p.field = i.field JOIN size s ON p.field = s.field GROUP BY id, p.term),
answer AS (SELECT term, id, sum(weight * part) AS part FROM hit JOIN wide USING (found) GROUP BY term, id),
total AS (SELECT query, id, round(sum(qf * part) * count(*), 6) AS score FROM answer JOIN asked USING (term) GROUP BY query, id)
SELECT query, id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM total QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20"""


@query("s_bm25_fuzzy", _FUZZY)
def s_bm25_fuzzy(t):
    """Every question against contents and first lines (which count double), with words near the asked ones and words that begin with them."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    post = N.field_postings(docs, {"content": X.index_tokens(F.col("text")), "name": X.index_tokens(F.split("text", "\n")[0])})
    asked = t.benchmark.select(F.col("item_id").alias("query"), F.explode(X.index_tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    return N.forgiving_search(post, asked, {"content": 1.0, "name": 2.0}, t.documents.count(), 20)


def _lloyd_sql(rounds: int) -> str:
    """The trained cells in SQL: the same first centres and rounds, then every vector's cells by distance."""
    far = "SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cell) AS n FROM v, c{}"
    steps = [
        "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)",
        "shape AS (SELECT least(100, floor(sqrt(count(*))))::BIGINT AS cells FROM v)",
        "c0 AS (SELECT row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS cell, v AS c FROM v QUALIFY cell < (SELECT cells FROM shape))",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED (SELECT * FROM ({far.format(k)}) WHERE n = 1)")
        steps.append(f"m{k} AS (SELECT cell, list(m ORDER BY i) AS c FROM (SELECT cell, i, avg(v[i]) AS m FROM a{k}, range(1, 65) r(i) GROUP BY ALL) GROUP BY cell)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cell, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cell))")
    return ", ".join([*steps, f"ranked AS MATERIALIZED ({far.format(rounds)})"])


#: Of ten cells these are probed: the fixture's vectors hardly cluster, and recall is to be 0.9.
PROBED = 7
_CELLS = _lloyd_sql(4)


@query("sink_vector_index", _CELLS + " SELECT id AS vec_id, cell FROM ranked WHERE n = 1")
def sink_vector_index(t):
    """The index: every vector under its trained cell, written and read back."""
    return V.CellIndex.built(t.embeddings, "vec_id", "embedding").lists.select(F.col("id").alias("vec_id"), "cell")


@query("s_knn_ivf", _CELLS + f", p AS (SELECT q.id AS query, x.id, round(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - x.v[i]) * (q.v[i] - x.v[i]))), 6) AS distance FROM ranked q JOIN ranked x ON q.cell = x.cell AND q.n <= (SELECT (cells * {PROBED} + 9) // 10 FROM shape) AND x.n = 1 WHERE q.id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p QUALIFY rank <= 10")
def s_knn_ivf(t):
    """The ten nearest in the probed cells of a trained index."""
    index = V.CellIndex.built(t.embeddings, "vec_id", "embedding")
    probes = -(-index.centres.count() * PROBED // 10)
    return index.search(t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes)


@query("s_encode", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 5)) AS unit FROM embeddings")
def s_encode(t):
    """Vectors of length one."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    signed = lambda x: F.signum(x) * F.abs(F.round(x, 5))  # noqa: E731  (a negative one that rounds to zero stays negative, as in SQL)
    return t.embeddings.select("vec_id", F.transform(e, lambda x: signed(x / norm)).alias("unit"))


_RERANK = _TERMS + _BM25 + _JAC + ", again AS (SELECT b.query, b.id, b.rank AS was, coalesce(j.score, 0)::DOUBLE AS score FROM bm_ranked b LEFT JOIN jac j USING (query, id) WHERE b.rank <= 10)"


@query("s_rerank", _RERANK + " SELECT query, id, was, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, was) AS rank FROM again")
def s_rerank(t):
    """The ten hits of BM25 by a lexical scorer, with the rank that they had."""
    hit = S.bm25(_terms(t), _asked(t), 10, t.documents.count()).select("query", "id", F.col("rank").alias("was"))
    docs = t.documents.join(hit.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    score = S.overlap(docs, "doc_id", "text", _questions(t), 1 << 30).select("query", "id", "score")
    x = hit.join(score, ["query", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "was")).cast("long"))


@query("s_import_hunt", _IMPORTS + r", base AS (SELECT 'src/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.py' AS file, max(p_size) / 50.0 AS base FROM part GROUP BY 1) SELECT file, target, max(round(0.45 * base + 1.7 * len(list_filter(list_distinct(string_split(regexp_replace(file, '^.*/|\.py$', '', 'g'), '_')), lambda w: contains(lower(name || ' ' || module || ' ' || target), w))) + 2.6 * confidence, 4))::DOUBLE AS score FROM found JOIN base USING (file) WHERE file <> target GROUP BY ALL")
def s_import_hunt(t):
    """Hits carried along resolved imports: a part of their own score, 1.7 for each of their words in the import or its target, 2.6 times the confidence."""
    folder, plain = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))
    base = t.part.groupBy(F.concat(F.lit("src/"), folder, F.lit("/"), plain, F.lit(".py")).alias("file")).agg((F.max("p_size") / 50.0).alias("base"))
    x = _imports(t).join(base, "file").where("file <> target")
    words, text = F.array_distinct(F.split(F.regexp_replace("file", r"^.*/|\.py$", ""), "_")), F.lower(F.concat_ws(" ", "name", "module", "target"))
    score = F.round(0.45 * F.col("base") + 1.7 * F.size(F.filter(words, lambda w: F.contains(text, w))) + 2.6 * F.col("confidence"), 4)
    return x.groupBy("file", "target").agg(F.max(score).alias("score"))


_SYMBOL_HITS = ", sym AS (SELECT query, id, max(tf)::DOUBLE AS score FROM terms JOIN asked USING (term) WHERE length(term) >= 8 GROUP BY ALL), sym_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sym), pool AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 8)::DOUBLE AS score, count(*) AS sources FROM (SELECT query, id, rank FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query, id, rank FROM jac_ranked WHERE rank <= 20 UNION ALL SELECT query, id, rank FROM sym_ranked WHERE rank <= 20) GROUP BY ALL)"


@query("s_retrieval", _TERMS + _BM25 + _JAC + _SYMBOL_HITS + " SELECT query, id, score, sources, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pool QUALIFY rank <= 10")
def s_retrieval(t):
    """Ranked words, shared words and long symbols, fused."""
    terms, asked = _terms(t), _asked(t)
    symbols = S.longest_use(terms, asked.where(F.length("term") >= 8), 20)
    return S.fused([S.bm25(terms, asked, 20, t.documents.count()), S.overlap(t.documents, "doc_id", "text", _questions(t), 20), symbols], 10)


@query("q_evidence_chunks", _TERMS + _BM25 + " SELECT query, id, rank, substr(text, 1, 300) AS chunk FROM bm_ranked JOIN documents ON id = doc_id WHERE rank <= 3")
def q_evidence_chunks(t):
    hit = S.bm25(_terms(t), _asked(t), 3, t.documents.count())
    return hit.join(t.documents, F.col("id") == F.col("doc_id")).select("query", "id", "rank", F.substring("text", 1, 300).alias("chunk"))


def _skill(fields: list[str], named: dict[str, Column], score: Column, least: float, t: Tables) -> DataFrame:
    """Scores of parts for the stated requirements, every twentieth part, that share a word with them."""
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name", *fields)
    return K.best(p, p.where("id % 20 = 0"), "p_name", fields, named, score, least, 4)


def _skill_sql(score: str, least: float) -> str:
    return f"WITH pairs AS (SELECT a.p_partkey AS ask, b.p_partkey AS id, string_split(a.p_name, ' ') AS n, string_split(b.p_name, ' ') AS m, a.p_type AS ty, b.p_type AS type, a.p_brand AS br, b.p_brand AS brand, a.p_size AS sz, b.p_size AS size FROM part a JOIN part b ON a.p_partkey % 20 = 0 AND a.p_partkey <> b.p_partkey AND len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0), s AS (SELECT ask, id, round({score}, 6)::DOUBLE AS score FROM pairs) SELECT ask, id, score FROM s WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) <= 4"


_JN = "len(list_intersect(n, m)) / len(list_distinct(list_concat(n, m)))"
_jn = lambda: {"j": X.jaccard(F.col("n"), F.col("m"))}
_same = lambda c: (F.col(c) == F.col(f"_of_{c}")).cast("int")


@query("s_skill_v1", _skill_sql(f"0.4 * {_JN} + 0.3 * (ty = type)::INT + 0.3 * (br = brand)::INT", 0.08))
def s_skill_v1(t):
    return _skill(["p_type", "p_brand"], _jn(), 0.4 * F.col("j") + 0.3 * _same("p_type") + 0.3 * _same("p_brand"), 0.08, t)


@query("s_skill_v2", _skill_sql(f"greatest({_JN}, 0.8 * (ty = type)::INT) * 0.6 + 0.4 * greatest(0, 1 - abs(sz - size) / 50.0)", 0.2))
def s_skill_v2(t):
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("p_size") - F.col("_of_p_size")) / 50.0)
    return _skill(["p_type", "p_size"], _jn(), F.greatest(F.col("j"), 0.8 * _same("p_type")) * 0.6 + 0.4 * near, 0.2, t)


@query("s_skill_semantic", _skill_sql(f"0.7 * {_JN} + 0.3 * (n[len(n)] = m[len(m)])::INT", 0.3))
def s_skill_semantic(t):
    last = (F.element_at("n", -1) == F.element_at("m", -1)).cast("int")
    return _skill([], {**_jn(), "last": last}, 0.7 * F.col("j") + 0.3 * F.col("last"), 0.3, t)


@query("q_skill_refs", _skill_sql("1.0 * len(list_intersect(n, m)) + 0.5 * (br = brand)::INT", 1.5))
def q_skill_refs(t):
    return _skill(["p_brand"], {"shared": F.size(F.array_intersect("n", "m"))}, 1.0 * F.col("shared") + 0.5 * _same("p_brand"), 1.5, t)


@query("s_path_score", FLOW + f", {_BACK} SELECT path, round(least(len(path), 8) * 0.5 + 0.35 * len(list_filter(path, lambda x: x % 3 = 0)) + 0.2 * (path[1] % 2 = 0)::INT + CASE WHEN len(path) > 5 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS score FROM p")
def s_path_score(t):
    """Worthiness, hits on the path, and what the first node and the partition add."""
    n = F.size("path")
    hits = F.size(F.filter("path", lambda x: x % 3 == 0))
    score = F.least(n, F.lit(8)) * 0.5 + 0.35 * hits + 0.2 * (F.col("path")[0] % 2 == 0).cast("int") + F.when(n > 5, 0.15).otherwise(0.0)
    return g_paths_leaf_to_entry(t).select("path", F.round(score, 6).alias("score"))


@query("s_ast_hunt", with_("sources") + "SELECT path, 'C' || key || '.m' || key AS caller, 'helper' AS symbol, 12::BIGINT AS line FROM sources")
def s_ast_hunt(t):
    """Where the calls of a symbol stand, by the syntax tree."""
    from graphloom.sources import code

    s = code.python_symbols(B.sources(t.part)).where("kind = 'call' and name = 'helper'")
    return s.select("path", F.col("owner").alias("caller"), F.col("name").alias("symbol"), "line")


@query("q_var_scope", with_("sources") + "SELECT string_split(path, '/')[2] AS folder, count(*) AS methods, 3 * count(*) AS names FROM sources GROUP BY 1")
def q_var_scope(t):
    """Methods of every folder, and the names in them."""
    from graphloom.sources import flow

    x = flow.statements(B.sources(t.part)).where("kind in ('param', 'def')").groupBy("path", "method").agg(F.count("*").alias("k"))
    return x.groupBy(F.split("path", "/")[1].alias("folder")).agg(F.count("*").alias("methods"), F.sum("k").alias("names"))
