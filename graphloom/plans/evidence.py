"""Queries of projections to a graph contract, resolution joins, evidence, plans and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import text as X
from graphloom.lineage import cut
from graphloom.operators import graph as G
from graphloom.operators import matching as M
from graphloom.operators import pairs as P
from graphloom.operators import ranking as R
from graphloom.operators import search as S
from graphloom.operators import symbols as Z
from graphloom.operators import traces as T
from graphloom.operators import units as U
from graphloom.plans.book import Tables, query
from graphloom.plans.graphs import _DEG, _SIDES, CALLS, CM, FLOW, RE, _calls, _extends, _flow, _starts
from graphloom.plans.relational import degrees, with_partitions
from graphloom.plans.retrieval import _BM25, _DEFAULT, _TERMS, _TOK, _asked, _terms
from graphloom.sources import bindings as B
from graphloom.sources import frameworks as Y
from graphloom.sources.bindings import with_

# ---- projections -------------------------------------------------------------

#: Kinds and relations of the graph contract (fixed values).
LABELS = {"signup": "Class", "purchase": "Method", "error": "Function", "view": "File"}
RELATIONS = {"A": "IMPORTS", "R": "EXTENDS"}


def mapped(column, table: dict[str, str], other: str):
    """A fixed mapping with a default."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column], F.lit(other))


@query("project_label_map", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'Class' WHEN 'purchase' THEN 'Method' WHEN 'error' THEN 'Function' WHEN 'view' THEN 'File' ELSE 'CodeElement' END AS label FROM events")
def project_label_map(t):
    return t.events.select("event_id", mapped(F.col("event_type"), LABELS, "CodeElement").alias("label"))


@query("project_rel_map", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'IMPORTS' WHEN 'R' THEN 'EXTENDS' ELSE 'CALLS' END AS rel FROM lineitem")
def project_rel_map(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", mapped(F.col("l_returnflag"), RELATIONS, "CALLS").alias("rel"))


@query("project_graph_contract", "SELECT o_orderkey, least(1.0, greatest(0.0, o_totalprice / 300000)) AS confidence, coalesce(steps, 0) AS step_count FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS steps FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def project_graph_contract(t):
    steps = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("steps"))
    return t.orders.join(steps, "o_orderkey", "left").select("o_orderkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o_totalprice") / 300000)).alias("confidence"), F.coalesce("steps", F.lit(0)).alias("step_count"))


@query("project_doc_text", "SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS text FROM part")
def project_doc_text(t):
    return t.part.select("p_partkey", F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("p_name", "p_brand", "p_type")]).alias("text"))


@query("project_language", "SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'html' WHEN url LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language FROM pages")
def project_language(t):
    return t.pages.select("page_id", F.when(F.col("url").endswith(".html"), "html").when(F.col("url").endswith(".py"), "python").otherwise("unknown").alias("language"))


@query("filter_test_files", "SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '(^|/)tests?/|_test\\.|test_')")
def filter_test_files(t):
    return t.pages.where(~F.lower("url").rlike(r"(^|/)tests?/|_test\.|test_")).select("page_id")


@query("filter_ignore_path", "SELECT page_id FROM pages WHERE len(list_intersect(string_split(url, '/'), ['node_modules', 'dist', 'build', '.git', 'tmp'])) = 0")
def filter_ignore_path(t):
    return t.pages.where(~F.arrays_overlap(F.split("url", "/"), F.array(*[F.lit(x) for x in ("node_modules", "dist", "build", ".git", "tmp")]))).select("page_id")


@query("filter_valid_call", "SELECT p_partkey, p_type FROM part WHERE len(string_split(p_type, ' ')) <= 2 AND string_split(p_type, ' ')[1] NOT IN ('append', 'items')")
def filter_valid_call(t):
    w = F.split("p_type", " ")
    return t.part.where((F.size(w) <= 2) & ~w[0].isin("append", "items")).select("p_partkey", "p_type")


# ---- joins ----------------------------------------------------------------------


@query("join_location_map", "SELECT 'part' AS kind, l_partkey AS node, min(l_suppkey) AS file FROM lineitem GROUP BY 2 UNION ALL SELECT 'order', o_orderkey, o_custkey FROM orders")
def join_location_map(t):
    return B.location(t.lineitem).select(F.lit("part").alias("kind"), "node", "file").union(t.orders.select(F.lit("order"), "o_orderkey", "o_custkey"))


@query("join_param_flow", CALLS + "SELECT caller, callee, coalesce(CASE WHEN b.p_size > 25 THEN b.p_type END, a.p_type) AS param FROM calls JOIN part a ON caller = a.p_partkey JOIN part b ON callee = b.p_partkey")
def join_param_flow(t):
    a = t.part.select(F.col("p_partkey").alias("caller"), F.col("p_type").alias("ta"))
    b = t.part.select(F.col("p_partkey").alias("callee"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("tb"))
    return B.calls(t.lineitem).join(a, "caller").join(b, "callee").select("caller", "callee", F.coalesce("tb", "ta").alias("param"))


@query("join_return_flow", CALLS + "SELECT caller, callee, CASE WHEN p_size > 40 THEN p_type ELSE 'result' END AS label FROM calls JOIN part ON callee = p_partkey")
def join_return_flow(t):
    p = t.part.select(F.col("p_partkey").alias("callee"), F.when(F.col("p_size") > 40, F.col("p_type")).otherwise("result").alias("label"))
    return B.calls(t.lineitem).join(p, "callee").select("caller", "callee", "label")


@query("join_member_edges", CM + "SELECT (SELECT count(*) FROM calls WHERE caller IN (SELECT node FROM member WHERE part <> 'Brand#11')) AS found, (SELECT count(*) FROM calls WHERE caller NOT IN (SELECT node FROM member WHERE part <> 'Brand#11')) AS missing")
def join_member_edges(t):
    known = B.membership(t.part).where("part <> 'Brand#11'").select(F.col("node").alias("caller"), F.lit(1).alias("hit"))
    return B.calls(t.lineitem).join(known, "caller", "left").agg(F.count("hit").alias("found"), F.sum(F.col("hit").isNull().cast("int")).alias("missing"))


@query("join_symbol_exact_fuzzy", "SELECT a.p_partkey, count(*) AS same_name, sum((a.p_brand = b.p_brand)::INT)::BIGINT AS same_place FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY 1")
def join_symbol_exact_fuzzy(t):
    n = W.partitionBy("p_name")
    exact = W.partitionBy("p_name", "p_brand")
    return t.part.select("p_partkey", F.count("*").over(n).alias("same_name"), F.count("*").over(exact).alias("same_place"))


@query("join_call_resolve", "WITH names AS (SELECT p_type, p_brand, min(p_partkey) AS target FROM part GROUP BY 1, 2), every AS (SELECT p_type, min(p_partkey) AS target, count(*) AS n FROM part GROUP BY 1) SELECT a.p_partkey, coalesce(CASE WHEN s.target <> a.p_partkey THEN s.target END, e.target) AS target, CASE WHEN s.target <> a.p_partkey THEN 0.85 WHEN e.n = 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM part a LEFT JOIN names s ON s.p_type = a.p_type AND s.p_brand = a.p_brand LEFT JOIN every e ON e.p_type = a.p_type")
def join_call_resolve(t):
    near = t.part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("near"))
    far = t.part.groupBy("p_type").agg(F.min("p_partkey").alias("far"), F.count("*").alias("n"))
    x = t.part.join(near, ["p_type", "p_brand"], "left").join(far, "p_type", "left")
    same = F.col("near") != F.col("p_partkey")
    return x.select("p_partkey", F.coalesce(F.when(same, F.col("near")), F.col("far")).alias("target"), F.when(same, 0.85).when(F.col("n") == 1, 0.5).otherwise(0.3).alias("confidence"))


@query("join_process_clusters", "SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey")
def join_process_clusters(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_custkey", "p_brand").distinct()


@query("join_hits_processes", "SELECT l_orderkey, count(DISTINCT l_partkey) AS hits, min(l_linenumber) AS step FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) GROUP BY 1")
def join_hits_processes(t):
    some = t.part.where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(some, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("hits"), F.min("l_linenumber").alias("step"))


@query("join_overrides", "SELECT n_name AS child, r_name AS parent, substr(n_name, 1, 1) AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE substr(n_name, 1, 1) = substr(r_name, 1, 1)")
def join_overrides(t):
    x = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.where(F.substring("n_name", 1, 1) == F.substring("r_name", 1, 1)).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.substring("n_name", 1, 1).alias("name"))


@query("join_shared_references", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def join_shared_references(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).where("parts > 1")


#: Methods by class, folder, first part of the name and parameters; weights of their agreement (fixed values).
METHOD_WEIGHTS, SIMILAR = {"class": 0.2, "folder": 0.2, "prefix": 0.15, "params": 0.15}, 0.3
_METHODS = """WITH methods AS (SELECT p_partkey AS id, p_brand || '.' || p_type AS class, p_partkey // 20 AS folder, split_part(replace(p_name, ' ', '_'), '_', 1) AS prefix, [split_part(p_name, ' ', 2) || p_size, p_type || p_size] AS params FROM part),
pairs AS (SELECT a.id AS a, b.id AS b, round(0.2 * coalesce(a.class = b.class, false)::INT + 0.2 * coalesce(a.folder = b.folder, false)::INT + 0.15 * coalesce(a.prefix = b.prefix, false)::INT + 0.15 * coalesce(list_has_any(a.params, b.params), false)::INT, 6)::DOUBLE AS score FROM methods a JOIN methods b ON a.id < b.id)"""


def similar_methods(t: Tables) -> DataFrame:
    name = F.split("p_name", " ")
    params = F.array(F.concat(name[1], F.col("p_size")), F.concat("p_type", F.col("p_size")))
    methods = t.part.select("p_partkey", F.concat_ws(".", "p_brand", "p_type").alias("class"), F.floor(F.col("p_partkey") / 20).alias("folder"), name[0].alias("prefix"), params.alias("params"))
    return P.agreeing(methods, "p_partkey", METHOD_WEIGHTS, SIMILAR, rare="folder")


@query("join_method_similarity", _METHODS + " SELECT * FROM pairs WHERE score >= 0.3")
def join_method_similarity(t):
    """Pairs of methods that agree in two of four kinds or more; rows meet on two kinds at once, those of equal class, prefix and parameters as one."""
    return similar_methods(t)


# ---- aggregations ------------------------------------------------------------------


@query("agg_edge_stats", "SELECT b.kind, coalesce(n, 0) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) b(kind) LEFT JOIN (SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1) USING (kind)")
def agg_edge_stats(t):
    kinds = t.spark.createDataFrame([(k,) for k in "ANRX"], "kind string")
    n = t.lineitem.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "kind", "left").na.fill(0, ["n"])


@query("agg_dataflow_stats", CALLS + "SELECT count(*) AS flows, count(DISTINCT caller) AS sources, count(DISTINCT callee) AS sinks FROM calls")
def agg_dataflow_stats(t):
    d = degrees(B.calls(t.lineitem))
    n = lambda c: F.sum((F.col(c) > 0).cast("int"))
    return d.agg(F.sum("outdeg").alias("flows"), n("outdeg").alias("sources"), n("indeg").alias("sinks"))


@query("agg_heuristic_label", "SELECT p_brand, coalesce(arg_max(w, (n, w)), 'Cluster') AS label FROM (SELECT p_brand, string_split(p_type, ' ')[1] AS w, count(*) AS n FROM part WHERE string_split(p_type, ' ')[1] NOT IN ('STANDARD') GROUP BY ALL) GROUP BY p_brand")
def agg_heuristic_label(t):
    w = t.part.select("p_brand", F.split("p_type", " ")[0].alias("w")).where("w <> 'STANDARD'").groupBy("p_brand", "w").agg(F.count("*").alias("n"))
    return w.groupBy("p_brand").agg(F.coalesce(F.max_by("w", F.struct("n", "w")), F.lit("Cluster")).alias("label"))


@query("agg_entry_summary", CALLS + f", {_DEG} SELECT count(*) AS candidates, sum((indeg = 0)::INT)::BIGINT AS effective, sum((outdeg = 0)::INT)::BIGINT AS excluded FROM degs")
def agg_entry_summary(t):
    n = lambda c: F.sum((F.col(c) == 0).cast("int"))
    return degrees(B.calls(t.lineitem)).agg(F.count("*").alias("candidates"), n("indeg").alias("effective"), n("outdeg").alias("excluded"))


@query("agg_path_stats", "SELECT o_custkey, count(*) AS total, sum((o_totalprice > 100000)::INT)::BIGINT AS valid, sum((o_totalprice <= 100000)::INT)::BIGINT AS dropped FROM orders GROUP BY 1")
def agg_path_stats(t):
    big = F.col("o_totalprice") > 100000
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("total"), F.sum(big.cast("int")).alias("valid"), F.sum((~big).cast("int")).alias("dropped"))


@query("agg_naming_patterns", "SELECT regexp_extract(p_name, '^[a-zA-Z]+') AS prefix, count(*) AS n FROM part GROUP BY 1")
def agg_naming_patterns(t):
    return t.part.groupBy(F.regexp_extract("p_name", "^[a-zA-Z]+", 0).alias("prefix")).agg(F.count("*").alias("n"))


@query("agg_shared_params", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def agg_shared_params(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_shared_state", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS users FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def agg_shared_state(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("users")).where("users >= 2")


@query("agg_read_contract", CM + f", {_SIDES}, c AS (SELECT p1 AS part, count(*) AS calls FROM sides GROUP BY 1) SELECT part, count(*) AS nodes, coalesce(max(calls), 0) AS calls, coalesce(max(calls), 0) > 0 AS has_calls FROM member LEFT JOIN c USING (part) GROUP BY part")
def agg_read_contract(t):
    m = B.membership(t.part)
    c = with_partitions(B.calls(t.lineitem), m).groupBy(F.col("p1").alias("part")).agg(F.count("*").alias("calls"))
    return m.groupBy("part").agg(F.count("*").alias("nodes")).join(c, "part", "left").select("part", "nodes", F.coalesce("calls", F.lit(0)).alias("calls"), (F.coalesce("calls", F.lit(0)) > 0).alias("has_calls"))


@query("agg_richness", FLOW + "SELECT part, count(*) AS richness FROM flow GROUP BY part")
def agg_richness(t):
    return _flow(t).groupBy("part").agg(F.count("*").alias("richness"))


@query("agg_fuse_skills", "SELECT lower(name) AS name, list_sort(list(DISTINCT src)) AS sources, max(score) AS score FROM (SELECT n_name AS name, 'nation' AS src, n_nationkey * 1.0::DOUBLE AS score FROM nation UNION ALL SELECT upper(n_name), 'upper', 3.0 FROM nation UNION ALL SELECT r_name, 'region', 2.0 FROM region) GROUP BY 1")
def agg_fuse_skills(t):
    u = t.nation.select(F.lower("n_name").alias("name"), F.lit("nation").alias("src"), F.col("n_nationkey").cast("double").alias("score"))
    u = u.union(t.nation.select(F.lower("n_name"), F.lit("upper"), F.lit(3.0))).union(t.region.select(F.lower("r_name"), F.lit("region"), F.lit(2.0)))
    return u.groupBy("name").agg(F.array_sort(F.collect_set("src")).alias("sources"), F.max("score").alias("score"))


@query("agg_rerank_compare", "SELECT round(avg(p_retailprice - p_size * 20), 4) AS delta, arg_max(p_partkey, (p_retailprice, -p_partkey)) = arg_max(p_partkey, (p_size, -p_partkey)) AS same_top FROM part")
def agg_rerank_compare(t):
    top = lambda c: F.max_by("p_partkey", F.struct(c, -F.col("p_partkey")))
    return t.part.agg(F.round(F.avg(F.col("p_retailprice") - F.col("p_size") * 20), 4).alias("delta"), (top("p_retailprice") == top("p_size")).alias("same_top"))


# ---- top-k and sets ----------------------------------------------------------------------


@query("topk_processes", "SELECT l_orderkey, count(*) AS steps FROM lineitem GROUP BY 1 ORDER BY steps DESC, l_orderkey LIMIT 200")
def topk_processes(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("steps")).orderBy(F.desc("steps"), "l_orderkey").limit(200)


@query("topk_partition_subset", CM + f", {_SIDES} SELECT p1 AS part, (10 * count(*) + count(DISTINCT caller))::BIGINT AS score FROM sides WHERE p1 = p2 GROUP BY 1 ORDER BY score DESC, part LIMIT 8")
def topk_partition_subset(t):
    e = with_partitions(B.calls(t.lineitem), B.membership(t.part)).where("p1 = p2")
    return e.groupBy(F.col("p1").alias("part")).agg((10 * F.count("*") + F.count_distinct("caller")).alias("score")).orderBy(F.desc("score"), "part").limit(8)


@query("topk_mixed_order", "SELECT url FROM pages ORDER BY (url LIKE '%/') DESC, lower(url), url LIMIT 100")
def topk_mixed_order(t):
    return t.pages.orderBy(F.desc(F.col("url").endswith("/")), F.lower("url"), "url").limit(100).select("url")


@query("set_union_paths", FLOW + ", two AS (SELECT a.part, a.caller AS x, b.callee AS y FROM flow a JOIN flow b ON a.callee = b.caller), u AS (SELECT part, caller AS x, callee AS y FROM flow UNION SELECT * FROM two) SELECT part, x, y FROM u QUALIFY row_number() OVER (PARTITION BY part ORDER BY x, y) <= 20")
def set_union_paths(t):
    f = _flow(t)
    two = f.toDF("part", "x", "m").join(f.select(F.col("caller").alias("m"), F.col("callee").alias("y")), "m").select("part", "x", "y")
    return R.capped(f.toDF("part", "x", "y").union(two).distinct(), "part", [F.col("x"), F.col("y")], 20)


@query("set_dedup_path_evidence", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL ORDER BY ALL")
def set_dedup_path_evidence(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("set_key_facts_merge", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS facts, max(value) AS best FROM events GROUP BY user_id")
def set_key_facts_merge(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("facts"), F.max("value").alias("best"))


# ---- graphs ---------------------------------------------------------------------------------


@query("g_inherit_cycles", RE + ", up(a, b, d) AS (SELECT child, parent, 1 FROM extends UNION ALL SELECT a, parent, d + 1 FROM up JOIN extends ON b = child WHERE d < 10) SELECT a FROM up WHERE a = b")
def g_inherit_cycles(t):
    return G.closure(_extends(t)).where("child = ancestor").select(F.col("child").alias("a"))


@query("g_paths_intermediate", FLOW + ", mid AS (SELECT callee AS node FROM flow WHERE callee IN (SELECT caller FROM flow) ORDER BY 1 LIMIT 30), p(path) AS (SELECT [node] FROM mid UNION ALL SELECT list_append(path, callee) FROM p JOIN flow ON path[-1] = caller WHERE len(path) < 10) SELECT path FROM p WHERE len(path) = 10 OR path[-1] NOT IN (SELECT caller FROM flow)")
def g_paths_intermediate(t):
    f = cut(_flow(t), "flow")
    mid = f.select(F.col("callee").alias("node")).join(f.select(F.col("caller").alias("node")), "node", "left_semi").distinct().orderBy("node").limit(30)
    return G.paths(f.select("caller", "callee"), mid, 10)


#: A part's file lies in one of these folders and ends in one of these ways (values of the binding).
FILE_FOLDERS = ("/pages/", "/pages/api/", "/App/", "/app/api/", "/routes/", "/http/controllers/", "/handlers/", "/api/", "/services/", "/views/", "/models/", "/sources/", "/bin/", "/lib/")
FILE_ENDS = ("_page.tsx", "route.ts", ".js", "_views.py", "/__init__.py", ".py", "Controller.java", ".java", ".cs", "/main.go", ".go", ".rs", "/main.cpp", ".php", "App.swift", ".swift", "\\index.js", ".md")


def _fixed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


_FILES = f"files AS (SELECT p_partkey, 'src' || ([{_fixed(FILE_FOLDERS)}])[p_size % {len(FILE_FOLDERS)} + 1] || replace(p_name, ' ', '_') || ([{_fixed(FILE_ENDS)}])[p_partkey % {len(FILE_ENDS)} + 1] AS path FROM part)"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{fo}', '{en}', '{ne}', '{ba}', '{fw}', {fa}::DOUBLE, '{re}')" for i, (fo, en, ne, ba, fw, fa, re) in enumerate(Y.RULES)) + ") r(n, folders, ends, needed, barred, framework, factor, reason))"


@query("g_framework_detect", f"WITH {_FILES}, {_RULES}, low AS (SELECT p_partkey, path, '/' || ltrim(replace(lower(path), chr(92), '/'), '/') AS p FROM files), held AS (SELECT p_partkey, min(n) AS n FROM low JOIN rules ON (folders = '' OR len(list_filter(string_split(folders, ' '), lambda x: contains(p, x))) > 0) AND (ends = '' OR len(list_filter(string_split(ends, ' '), lambda x: ends_with(p, x))) > 0) AND (needed = '' OR contains(p, needed)) AND (barred = '' OR len(list_filter(string_split(barred, ' '), lambda x: contains(p, x))) = 0) GROUP BY 1) SELECT p_partkey, path, framework, coalesce(factor, 1.0)::DOUBLE AS factor, reason FROM low LEFT JOIN held USING (p_partkey) LEFT JOIN rules USING (n)")
def g_framework_detect(t):
    """The framework that a part's path tells, by the first of the ordered rules."""
    pick = lambda values, i: F.get(F.array(*[F.lit(x) for x in values]), (F.col(i) % len(values)).cast("int"))
    path = F.concat(F.lit("src"), pick(FILE_FOLDERS, "p_size"), F.translate("p_name", " ", "_"), pick(FILE_ENDS, "p_partkey"))
    found = t.part.select("p_partkey", path.alias("path")).withColumn("x", Y.framework(Y.normal_path(F.col("path"))))
    return found.select("p_partkey", "path", "x.framework", "x.factor", "x.reason")


@query("g_explore", CM + "SELECT node, part, func, (SELECT count(*) FROM calls WHERE caller = node) AS outs, (SELECT count(*) FROM calls WHERE callee = node) AS ins FROM member WHERE part = 'Brand#11'")
def g_explore(t):
    d = degrees(B.calls(t.lineitem))
    return B.membership(t.part).where("part = 'Brand#11'").join(d, "node", "left").select("node", "part", "func", F.coalesce("outdeg", F.lit(0)).alias("outs"), F.coalesce("indeg", F.lit(0)).alias("ins"))


@query("g_overview", "SELECT 'cluster' AS kind, p_brand AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'process', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2")
def g_overview(t):
    part = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return part(t.part, "cluster", "p_brand").union(part(t.orders, "process", "o_orderpriority")).union(part(t.events, "event", "event_type"))


@query("g_key_paths", CALLS + ", first AS (SELECT callee AS node, min(caller) AS up FROM calls GROUP BY 1), top AS (SELECT callee AS node, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, node LIMIT 5) SELECT t.node, t.n, up FROM top t JOIN first f ON t.node = f.node")
def g_key_paths(t):
    g = _calls(t).groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n"), F.min("caller").alias("up"))
    return g.orderBy(F.desc("n"), "node").limit(5)


@query("g_build_graph", CM + "SELECT 'CALLS' AS type, count(*) AS n FROM calls UNION ALL SELECT 'MEMBER_OF', count(*) FROM member UNION ALL SELECT 'DEFINES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'CONTAINS', count(*) FROM nation")
def g_build_graph(t):
    edges = B.calls(t.lineitem).select(F.lit("CALLS").alias("type")).union(t.part.select(F.lit("MEMBER_OF"))).union(t.lineitem.select("l_suppkey", "l_partkey").distinct().select(F.lit("DEFINES"))).union(t.nation.select(F.lit("CONTAINS")))
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query("g_heritage", "SELECT n_name AS child, r_name AS parent, 'EXTENDS' AS type, 1.0::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey")
def g_heritage(t):
    x = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lit("EXTENDS").alias("type"), F.lit(1.0).alias("confidence"))


@query("g_path_subsequence", "WITH paths AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS path FROM lineitem GROUP BY 1), asked AS (SELECT id AS ask, list_filter(path, lambda x, i: i % 2 = 1) AS nodes FROM paths WHERE id % 20 = 0) SELECT ask, id FROM asked JOIN paths ON list_has_all(path, nodes) WHERE list_reduce(list_prepend(1::BIGINT, path), lambda done, x: CASE WHEN done <= len(nodes) AND nodes[done] = x THEN done + 1 ELSE done END) = len(nodes) + 1")
def g_path_subsequence(t):
    """Each second node of the stated orders' paths, looked for in order among all paths."""
    line = F.struct("l_linenumber", "l_partkey")
    paths = cut(t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("x")).select("id", F.col("x.l_partkey").alias("path")), "paths")
    asked = paths.where("id % 20 = 0").select(F.col("id").alias("ask"), F.filter("path", lambda x, i: i % 2 == 0).alias("nodes"))
    return T.subsequences(asked, paths)


# ---- search ------------------------------------------------------------------------------------


@query("s_tokenize_cjk", "SELECT n_nationkey, list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2)) AS grams FROM nation WHERE length(n_name) > 1")
def s_tokenize_cjk(t):
    return t.nation.where(F.length("n_name") > 1).select("n_nationkey", X.bigrams(F.col("n_name")).alias("grams"))


@query("s_exact_ids", f"SELECT item_id, list_sort(list_distinct(list_filter({_TOK.format(t='text')}, lambda w: length(w) >= 12))) AS ids FROM benchmark")
def s_exact_ids(t):
    return t.benchmark.select("item_id", F.array_sort(F.array_distinct(F.filter(X.words(F.col("text")), lambda w: F.length(w) >= 12))).alias("ids"))


@query("s_path_hints", "SELECT page_id, regexp_extract_all(url, '[a-z0-9_]+/[a-z0-9_]+') AS hints FROM pages")
def s_path_hints(t):
    return t.pages.select("page_id", F.regexp_extract_all("url", F.lit("[a-z0-9_]+/[a-z0-9_]+"), F.lit(0)).alias("hints"))


def _plans_sql(asked: str, corpus: str) -> str:
    """Query plans of ``asked`` (query, text) and their features in ``corpus`` (id, path, low) in SQL; words are marked so that "and" and "then" are found whole."""
    stop = ", ".join(repr(w) for w in M.STOPWORDS)
    marked = r"regexp_replace(trim(text), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g')"
    cut_ = rf"replace(replace(regexp_replace({marked}, '(?i)\x01(and|then)\x02', ';', 'g'), chr(1), ''), chr(2), '')"
    return rf"""WITH {asked}, root AS (SELECT query, trim(text) AS text, list_filter(list_transform(regexp_split_to_array({cut_}, '->|=>|;|；|,|，|并且|然后|再|以及'), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: s <> '') AS parts FROM asked WHERE trim(text) <> ''),
every AS (SELECT query, 0 AS n, 'primary' AS kind, 1.0::DOUBLE AS weight, text FROM root UNION ALL SELECT query, unnest(range(1, len(parts) + 1)), 'segment', 0.78, unnest(parts) FROM root
  UNION ALL SELECT query, 100000, 'bridge', 0.72, parts[1] || ' ' || parts[-1] FROM root WHERE len(list_distinct(parts)) >= 2),
plans AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY n) - 1 AS plan, kind, weight, text FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query, text ORDER BY n) = 1) QUALIFY plan < 6),
lists AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]+|[\x{{4e00}}-\x{{9fff}}][\x{{4e00}}-\x{{9fff}}]+'), lambda w: w NOT IN ({stop})) AS t,
  list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_][A-Za-z0-9_][A-Za-z0-9_]+'), lambda w: contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]|[A-Z][a-z]') OR length(w) >= 12), lambda w: lower(w)), lambda w: w NOT IN ({stop})) AS i FROM plans),
firsts AS (SELECT *, list_slice(list_filter(t, lambda w, k: list_position(t, w) = k), 1, 16) AS terms, list_slice(list_filter(i, lambda w, k: list_position(i, w) = k), 1, 16) AS names FROM lists),
feature AS (SELECT query, plan, 'term' AS f, unnest(terms) AS x FROM firsts UNION ALL SELECT query, plan, 'name', unnest(names) FROM firsts UNION ALL SELECT query, plan, 'phrase', lower(text) FROM firsts WHERE length(text) >= 6
  UNION ALL SELECT query, plan, 'hint', unnest(list_distinct(list_transform(regexp_extract_all(text, '[^\s,;，；]+/[^\s,;，；]+'), lambda h: lower(h)))) FROM firsts),
{corpus},
worth AS (SELECT f, x, id, (CASE f WHEN 'term' THEN 22 * contains(path, x)::INT + 11 * least(n, 8) WHEN 'phrase' THEN 25 * (n > 0)::INT
  WHEN 'hint' THEN CASE WHEN contains(path, x) THEN 30 WHEN regexp_extract(x, '[^/]*$') <> '' AND contains(path, regexp_extract(x, '[^/]*$')) THEN 20 ELSE 0 END
  ELSE 45 * contains(path, x)::INT + 18 * least(n, 4) + CASE WHEN n = 0 THEN 0 WHEN contains(low, 'def ' || x || '(') THEN 120 WHEN contains(low, 'class ' || x) OR contains(low, 'function ' || x || '(') THEN 100 WHEN contains(low, 'const ' || x || ' =') OR contains(low, 'let ' || x || ' =') THEN 80 ELSE 0 END END)::BIGINT AS v
  FROM (SELECT *, (length(low) - length(replace(low, x, ''))) // length(x) AS n FROM (SELECT DISTINCT f, x FROM feature), corpus)),
scored AS (SELECT query, plan, id, round((sum(v) + CASE WHEN any_value(path) LIKE '%.py' THEN 2 ELSE 0 END) / 10 * weight, 4) AS score FROM feature JOIN worth USING (f, x) JOIN plans USING (query, plan) JOIN corpus USING (id) WHERE v > 0 GROUP BY query, plan, id, weight),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY score DESC, plan) = 1)"""


_PLANS = _plans_sql("asked AS (SELECT item_id AS query, text FROM benchmark)", "corpus AS (SELECT doc_id AS id, lower(coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.md') AS path, lower(text) AS low FROM documents)")
_TOP = " SELECT query, id, plan, kind, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(path), id) AS rank FROM {} JOIN corpus USING (id) JOIN plans USING (query, plan) {} QUALIFY rank <= 20"


def _corpus(t: Tables) -> DataFrame:
    """(id, path, text): documents in a folder for each source and language."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.documents.select(F.col("doc_id").alias("id"), path.alias("path"), "text")


def _plans(t: Tables) -> DataFrame:
    return M.query_plans(t.benchmark.select(F.col("item_id").alias("query"), "text"))


@query("s_query_plans", _PLANS + " SELECT query, plan, kind, weight, text FROM plans")
def s_query_plans(t):
    """Every question, its segments and the bridge of the first and the last."""
    return _plans(t)


@query("s_text_match_score", _PLANS + _TOP.format("scored", "WHERE plan = 0"))
def s_text_match_score(t):
    """The 20 best documents of every question by words, path, hints, phrase and identifiers."""
    return M.matches(_corpus(t), _plans(t).where("plan = 0"), 20)


@query("s_best_plan", _PLANS + _TOP.format("best", ""))
def s_best_plan(t):
    """The 20 best documents of every question, each by the plan that suits it best."""
    return M.matches(_corpus(t), _plans(t), 20)


@query("s_embed_text", r"SELECT p_partkey, trim(regexp_replace(concat_ws(' ', p_type, p_name, 'size', p_size::VARCHAR), ' +', ' ', 'g')) AS text FROM part")
def s_embed_text(t):
    return t.part.select("p_partkey", F.trim(F.regexp_replace(F.concat_ws(" ", "p_type", "p_name", F.lit("size"), F.col("p_size").cast("string")), " +", " ")).alias("text"))


@query("s_secret_lines", "SELECT doc_id, i AS line, regexp_extract(l, '(token|password) ?=', 1) AS symbol FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, '(token|password) ?=')")
def s_secret_lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).where(F.col("l").rlike("(token|password) ?="))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.regexp_extract("l", "(token|password) ?=", 1).alias("symbol"))


_HUNT = _plans_sql(
    with_("sources").removeprefix("WITH ").strip() + ", asked AS (SELECT s_suppkey AS query, 'open ' || replace(path, 'src/', 'lib/') || ' and then find class C' || s_suppkey || ', method m' || s_suppkey AS text FROM supplier JOIN sources ON key = s_suppkey)",
    "corpus AS (SELECT key AS id, lower(path) AS path, lower(content) AS low FROM sources)",
) + rf""", top AS (SELECT query, id, score AS base, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(path), id) AS rank FROM best JOIN corpus USING (id) QUALIFY rank <= 60),
pieces AS (SELECT query, plan, terms, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]+') AS tokens FROM firsts),
words AS (SELECT query, plan, list_concat(terms, list_filter(flatten(list_transform(tokens, lambda t: list_transform(list_concat(regexp_split_to_array(translate(t, '._', '  '), ' +'), regexp_extract_all(t, '[A-Z]?[a-z]+|[A-Z]+|\d+')), lambda w: lower(w)))), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(repr(w) for w in M.STOPWORDS)}))) AS w FROM pieces),
short AS (SELECT query, plan, list_slice(list_filter(w, lambda x, k: list_position(w, x) = k), 1, 24) AS w FROM words),
every_word AS (SELECT query, flatten(list(w ORDER BY plan)) AS w FROM short GROUP BY query),
look AS (SELECT query, list_slice(list_filter(w, lambda x, k: list_position(w, x) = k), 1, 30) AS w FROM every_word),
lines AS (SELECT key AS id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM sources),
defs AS (SELECT id, line, coalesce(nullif(regexp_extract(l, '^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), ''), nullif(regexp_extract(l, '^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b', 1), '')) AS symbol FROM lines WHERE regexp_matches(l, '^\s*(def|class)\s')),
hits AS (SELECT query, id, symbol, line, rank, path, base, list_sum(list_transform(w, lambda x: CASE WHEN x = lower(symbol) THEN 60 WHEN contains(lower(symbol), x) THEN 28 ELSE 0 END)) AS tenths, (SELECT 'm' || t.query || '.py') AS hint FROM top t JOIN defs USING (id) JOIN corpus USING (id) JOIN look USING (query) WHERE symbol IS NOT NULL)
SELECT query, id, symbol, line, round(tenths / 10 + CASE WHEN contains(path, hint) THEN 1.2 ELSE 0 END + greatest(0, 1.4 - rank * 0.03) + base * 0.35, 4)::DOUBLE AS score FROM hits WHERE tenths > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, line) <= 20"""


@query("s_symbol_hunt", _HUNT)
def s_symbol_hunt(t):
    """The symbols that every supplier's question touches, in the 60 files that match it best."""
    files = cut(B.sources(t.part).select(F.col("key").alias("id"), "path", F.col("content").alias("text")), "files")
    text = F.concat(F.lit("open "), F.replace("path", F.lit("src/"), F.lit("lib/")), F.lit(" and then find class C"), F.col("s_suppkey"), F.lit(", method m"), F.col("s_suppkey"))
    plans = cut(M.query_plans(t.supplier.join(files, F.col("s_suppkey") == F.col("id")).select(F.col("s_suppkey").alias("query"), text.alias("text"))), "plans")
    return Z.symbol_hits(files, plans, M.matches(files, plans, Z.FILES), 20)


@query("s_followup", _TERMS + _BM25 + ", hit AS (SELECT query, id FROM bm_ranked WHERE rank <= 3), w AS (SELECT query, term, sum(tf)::BIGINT AS n FROM hit JOIN terms USING (id) GROUP BY ALL) SELECT query, term, n FROM w WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.query = w.query AND a.term = w.term) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, term) <= 30")
def s_followup(t):
    terms = _terms(t)
    hit = S.bm25(terms, _asked(t), 3, t.documents.count()).select("query", "id")
    w = S.term_rows(terms).join(hit, "id").groupBy("query", "term").agg(F.sum("tf").alias("n")).join(_asked(t), ["query", "term"], "left_anti")
    return R.capped(w, "query", [F.desc("n"), F.col("term")], 30)


@query("s_overlap_signal", _TERMS + _BM25 + ", n AS (SELECT query, count(*) AS m FROM asked GROUP BY 1), k AS (SELECT query, id, count(*) AS hits FROM terms JOIN asked USING (term) GROUP BY ALL) SELECT query, id, round((hits + hits / m) * 0.5, 6)::DOUBLE AS signal FROM k JOIN n USING (query) JOIN bm_ranked b USING (query, id) WHERE rank <= 5")
def s_overlap_signal(t):
    terms, asked = _terms(t), _asked(t)
    m = asked.groupBy("query").agg(F.count("*").alias("m"))
    top = S.bm25(terms, asked, 5, t.documents.count()).select("query", "id")
    k = S.term_rows(terms).join(top, "id").join(asked, ["query", "term"]).groupBy("query", "id").agg(F.count("*").alias("hits"))
    return top.join(k, ["query", "id"]).join(m, "query").select("query", "id", F.round((F.col("hits") + F.col("hits") / F.col("m")) * 0.5, 6).alias("signal"))


_D = "list_distinct(" + _DEFAULT + ")"


@query("s_unit_relevance", f"WITH turns AS (SELECT conv_id AS id, turn, {_DEFAULT.format(t='text')} AS w, max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations), words AS (SELECT DISTINCT id, 1.0 AS x, unnest(w) AS word FROM turns UNION ALL SELECT DISTINCT id, 2.0, unnest(w) FROM turns WHERE turn = 0 UNION ALL SELECT DISTINCT id, 1.5, unnest(w) FROM turns WHERE turn = final), asked AS (SELECT item_id AS query, unnest({_D.format(t='text')}) AS word FROM benchmark), s AS (SELECT query, id, sum(x)::DOUBLE AS total FROM words JOIN asked USING (word) GROUP BY ALL), r AS (SELECT query, id, round(total * greatest(0.5, 1 - 0.1 * (7 - final)), 6)::DOUBLE AS score FROM s JOIN (SELECT DISTINCT id, final FROM turns) USING (id)) SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5")
def s_unit_relevance(t):
    """Every question against all conversations: words of all turns, of the first (topic) and of the last (summary); each turn short of eight is a day of age."""
    first, last = F.struct("turn", "w"), F.max("turn")
    turns = t.conversations.select(F.col("conv_id").alias("id"), "turn", X.default_tokens(F.col("text")).alias("w"))
    units = turns.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("keywords"), F.min(first).alias("a"), F.max(first).alias("z"), (7 - last).alias("days"))
    units = units.select("id", "keywords", F.when(F.col("a.turn") == 0, F.col("a.w")).alias("topic"), F.col("z.w").alias("summary"), "days")
    return U.relevant(units, t.benchmark.select(F.col("item_id").alias("query"), X.default_tokens(F.col("text")).alias("words")), 5)


@query("s_evidence_verdict", "SELECT user_id, bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error' AND value > 90) AS passed FROM events GROUP BY user_id")
def s_evidence_verdict(t):
    bad = (F.col("event_type") == "error") & (F.col("value") > 90)
    return t.events.groupBy("user_id").agg((F.bool_or(F.col("event_type") == "purchase") & ~F.bool_or(bad)).alias("passed"))


@query("s_cache_lookup", "SELECT lower(trim(event_type)) AS key, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 0 GROUP BY 1")
def s_cache_lookup(t):
    return t.events.where("value > 0").groupBy(F.lower(F.trim("event_type")).alias("key")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("s_advisor_cascade", with_("member") + ", f AS (SELECT part, round(avg(p_retailprice), 4) AS s FROM member JOIN part p ON node = p_partkey GROUP BY part), g AS (SELECT func, round(avg(p_retailprice), 4) AS s FROM member JOIN part p ON node = p_partkey GROUP BY func) SELECT p_partkey, round(p_retailprice + 0.55 * f.s + 0.65 * g.s, 4) AS score FROM part JOIN f ON p_brand = f.part JOIN g ON p_type = g.func")
def s_advisor_cascade(t):
    f = t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("fs"))
    g = t.part.groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("gs"))
    return t.part.join(f, "p_brand").join(g, "p_type").select("p_partkey", F.round(F.col("p_retailprice") + 0.55 * F.col("fs") + 0.65 * F.col("gs"), 4).alias("score"))


# ---- secondary ----------------------------------------------------------------------------------


@query("q_priority_boost", "SELECT o_orderkey, round(greatest(0.12, 0.6 - 0.12 * (substr(o_orderpriority, 1, 1)::INT - 1)), 6)::DOUBLE AS boost FROM orders")
def q_priority_boost(t):
    return t.orders.select("o_orderkey", F.round(F.greatest(F.lit(0.12), 0.6 - 0.12 * (F.substring("o_orderpriority", 1, 1).cast("int") - 1)), 6).alias("boost"))


@query("q_cluster_enrich", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def q_cluster_enrich(t):
    return R.capped(t.part, "p_brand", [F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query("q_coverage_gate", "SELECT conv_id, bool_or(text LIKE '%the%') AND bool_or(role = 'assistant') AS covered FROM conversations GROUP BY conv_id")
def q_coverage_gate(t):
    return t.conversations.groupBy("conv_id").agg((F.bool_or(F.col("text").contains("the")) & F.bool_or(F.col("role") == "assistant")).alias("covered"))


@query("q_feedback_route", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'repair' WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'purchase' THEN 'done' ELSE 'continue' END AS next FROM events")
def q_feedback_route(t):
    e = F.col("event_type")
    return t.events.select("event_id", F.when((e == "error") & (F.col("value") > 50), "repair").when(e == "error", "retry").when(e == "purchase", "done").otherwise("continue").alias("next"))


@query("q_partition_candidates", "SELECT p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY p_brand")
def q_partition_candidates(t):
    some = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(some, "p_partkey", "left_semi").select("p_brand").distinct()


@query("q_partition_name", "SELECT p_brand, arg_max(w, (n, w)) AS name FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w, 1 AS k FROM part) JOIN (SELECT p_brand AS b, w AS v, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY ALL) ON b = p_brand AND v = w GROUP BY p_brand")
def q_partition_name(t):
    w = t.part.select("p_brand", F.explode(F.split("p_type", " ")).alias("w")).groupBy("p_brand", "w").agg(F.count("*").alias("n"))
    return w.groupBy("p_brand").agg(F.max_by("w", F.struct("n", "w")).alias("name"))


@query("q_index_export", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q_index_export(t):
    x = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s")))).alias("c"))
    return x.select("conv_id", F.array_join(F.transform("c", lambda s: s["s"]), "\n").alias("text"))


@query("q_related_files", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS files FROM lineitem GROUP BY 1")
def q_related_files(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("files"))


@query("q_stock_batch", "SELECT c_custkey, coalesce(total, 0)::DOUBLE AS total, CASE WHEN total IS NULL THEN 'missing' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q_stock_batch(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return t.customer.join(s, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"), F.when(F.col("total").isNull(), "missing").otherwise("ok").alias("status"))


@query("q_type_dispatch", "SELECT event_id, CASE WHEN props IS NULL THEN 0 ELSE length(props) END::BIGINT AS size FROM events")
def q_type_dispatch(t):
    return t.events.select("event_id", F.coalesce(F.length("props"), F.lit(0)).cast("long").alias("size"))


@query("q_skill_quality", "SELECT lang, count(*) AS total, sum((n_chars >= 1000)::INT)::BIGINT AS usable, sum((n_chars < 200)::INT)::BIGINT AS low FROM documents GROUP BY lang")
def q_skill_quality(t):
    n = lambda c: F.sum(F.expr(c).cast("int"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("total"), n("n_chars >= 1000").alias("usable"), n("n_chars < 200").alias("low"))


@query("q_enhance_rels", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM lineitem")
def q_enhance_rels(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), 0.9).otherwise(0.6).alias("confidence"))


@query("q_default_partitions", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS files FROM pages GROUP BY 1")
def q_default_partitions(t):
    return t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("files"))


@query("q_intent_rules", "SELECT conv_id, turn, CASE WHEN text LIKE '%?%' AND length(text) < 80 THEN 'simple' WHEN text LIKE '%?%' THEN 'question' ELSE 'task' END AS intent FROM conversations")
def q_intent_rules(t):
    q = F.col("text").contains("?")
    return t.conversations.select("conv_id", "turn", F.when(q & (F.length("text") < 80), "simple").when(q, "question").otherwise("task").alias("intent"))


@query("q_lightweight_paths", FLOW + ", starts AS (SELECT caller AS node FROM flow WHERE caller NOT IN (SELECT callee FROM flow)), p(path) AS (SELECT [node] FROM starts UNION ALL SELECT list_append(path, callee) FROM p JOIN flow ON path[-1] = caller WHERE len(path) < 3) SELECT path FROM p")
def q_lightweight_paths(t):
    f = cut(_flow(t), "flow")
    return G.paths(f.select("caller", "callee"), _starts(f), 3, every=True)
