"""Queries of graph traversal, motifs, communities and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.lineage import cut
from graphloom.operators import cycles as Y
from graphloom.operators import graph as G
from graphloom.plans.book import Tables, query
from graphloom.plans.relational import _DEG, _SIDES, degrees, with_partitions
from graphloom.sources import bindings as B
from graphloom.sources.bindings import with_

RC, RE = with_("calls", recursive=True), with_("extends", recursive=True)
CM = with_("calls", "member")
FLOW = "WITH RECURSIVE flow AS (SELECT o_custkey AS part, o_orderkey AS caller, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS callee FROM orders QUALIFY callee IS NOT NULL) "
CALLS = with_("calls")


def _calls(t: Tables) -> DataFrame:
    return cut(B.calls(t.lineitem), "calls")


def _flow(t: Tables) -> DataFrame:
    """A sparse graph in partitions: every customer's orders, one after the other."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("caller"), F.lead("o_orderkey").over(w).alias("callee")).where("callee is not null")


def _extends(t: Tables) -> DataFrame:
    return B.extends(t.region, t.nation, t.customer)


def _seed(t: Tables, *nodes: int) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in nodes], "node long")


_REACH = "r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT callee, depth + 1 FROM r JOIN calls ON node = caller WHERE depth < 64)"


@query("g_bfs_levels", RC + f", {_REACH} SELECT node, min(depth) AS depth FROM r GROUP BY node")
def g_bfs_levels(t):
    return G.bfs_levels(_calls(t), _seed(t, 1))


@query("g_transitive_deps", RC + ", r(node) AS (SELECT 1::BIGINT UNION SELECT callee FROM r JOIN calls ON node = caller) SELECT node FROM r WHERE node <> 1")
def g_transitive_deps(t):
    return G.bfs_levels(_calls(t), _seed(t, 1)).where("depth > 0").select("node")


@query("g_shortest_chain", RC + f", {_REACH} SELECT min(depth) AS length FROM r WHERE node = 100")
def g_shortest_chain(t):
    return G.bfs_levels(_calls(t), _seed(t, 1)).where("node = 100").agg(F.min("depth").alias("length"))


@query("g_critical_path", RC + f", {_REACH} SELECT max(depth) AS depth, CASE WHEN max(depth) >= 4 THEN 'long' ELSE 'short' END AS bucket FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node)")
def g_critical_path(t):
    return G.bfs_levels(_calls(t), _seed(t, 1)).agg(F.max("depth").alias("depth"), F.when(F.max("depth") >= 4, "long").otherwise("short").alias("bucket"))


_CHAIN = "p(path) AS (SELECT [1::BIGINT] UNION ALL SELECT list_append(path, callee) FROM p JOIN calls ON path[-1] = caller WHERE len(path) < {n} AND NOT list_contains(path, callee))"


@query("g_call_tree", RC + f", {_CHAIN.format(n=3)} SELECT path FROM p")
def g_call_tree(t):
    return G.paths(_calls(t), _seed(t, 1), 3, every=True)


@query("g_all_chains", RC + f", {_CHAIN.format(n=3)} SELECT path[-1] AS node, min(path) AS path FROM p GROUP BY 1")
def g_all_chains(t):
    return G.paths(_calls(t), _seed(t, 1), 3, every=True).groupBy(F.element_at("path", -1).alias("node")).agg(F.min("path").alias("path"))


@query("g_trace_execution", RC + f", {_REACH}, d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node, row_number() OVER (ORDER BY depth, node) AS step FROM d ORDER BY step LIMIT 200")
def g_trace_execution(t):
    d = G.bfs_levels(_calls(t), _seed(t, 1)).orderBy("depth", "node").limit(200)
    return d.select("node", F.row_number().over(W.orderBy("depth", "node")).cast("long").alias("step"))


@query("g_cycles", CALLS + "SELECT [a.caller, a.callee] AS path FROM calls a JOIN calls b ON b.caller = a.callee AND b.callee = a.caller WHERE a.caller < a.callee UNION ALL SELECT [a.caller, a.callee, b.callee] FROM calls a JOIN calls b ON b.caller = a.callee JOIN calls c ON c.caller = b.callee AND c.callee = a.caller WHERE a.caller < least(a.callee, b.callee) AND a.callee <> b.callee")
def g_cycles(t):
    """All cycles of up to three calls, each from its smallest node."""
    return Y.cycles(_calls(t), 3)


@query("g_strong_components", RC + ", r(a, b) AS (SELECT caller, callee FROM calls UNION SELECT a, callee FROM r JOIN calls ON b = caller) SELECT x.a AS node, min(x.b) AS comp FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING max(x.b) > x.a OR min(x.b) < x.a")
def g_strong_components(t):
    """Strongly connected components of all calls, of two nodes or more."""
    return Y.strong_components(_calls(t))


@query("g_triangles", CALLS + "SELECT x.caller AS a, x.callee AS b, y.callee AS c FROM calls x JOIN calls y ON x.callee = y.caller JOIN calls z ON z.caller = y.callee AND z.callee = x.caller WHERE x.caller < x.callee AND x.caller < y.callee AND x.callee <> y.callee")
def g_triangles(t):
    return G.triangles(_calls(t))


@query("g_pattern_cycle", CALLS + "SELECT x.caller AS a, x.callee AS b FROM calls x JOIN calls y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee")
def g_pattern_cycle(t):
    return G.mutual(_calls(t))


@query("g_file_cycles", with_("calls", "location") + ", f AS (SELECT DISTINCT a.file AS s, b.file AS d FROM calls JOIN location a ON caller = a.node JOIN location b ON callee = b.node WHERE a.file <> b.file) SELECT x.s AS a, x.d AS b FROM f x JOIN f y ON x.s = y.d AND x.d = y.s WHERE x.s < x.d")
def g_file_cycles(t):
    loc = B.location(t.lineitem)
    f = _calls(t).join(loc.toDF("caller", "s"), "caller").join(loc.toDF("callee", "d"), "callee").where("s <> d").select(F.col("s").alias("caller"), F.col("d").alias("callee")).distinct()
    return G.mutual(cut(f, "files"))


@query("g_pattern_fanout", CALLS + "SELECT caller AS hub, count(*) AS n FROM calls GROUP BY 1 HAVING count(*) >= 3")
def g_pattern_fanout(t):
    return _calls(t).groupBy(F.col("caller").alias("hub")).agg(F.count("*").alias("n")).where("n >= 3")


@query("g_pattern_fanin", CALLS + "SELECT callee AS hub, count(*) AS n FROM calls GROUP BY 1 HAVING count(*) >= 3")
def g_pattern_fanin(t):
    return _calls(t).groupBy(F.col("callee").alias("hub")).agg(F.count("*").alias("n")).where("n >= 3")


_FWD = "starts AS (SELECT caller AS node FROM flow WHERE caller NOT IN (SELECT callee FROM flow)), p(path) AS (SELECT [node] FROM starts UNION ALL SELECT list_append(path, callee) FROM p JOIN flow ON path[-1] = caller WHERE len(path) < {n})"


def _starts(flow: DataFrame) -> DataFrame:
    return flow.select(F.col("caller").alias("node")).join(flow.select(F.col("callee").alias("node")), "node", "left_anti")


@query("g_paths_entry_forward", FLOW + f", {_FWD.format(n=15)} SELECT path FROM p WHERE len(path) = 15 OR path[-1] NOT IN (SELECT caller FROM flow)")
def g_paths_entry_forward(t):
    f = cut(_flow(t), "flow")
    return G.paths(f.select("caller", "callee"), _starts(f), 15)


_BACK = "ends AS (SELECT callee AS node FROM flow WHERE callee NOT IN (SELECT caller FROM flow)), p(path) AS (SELECT [node] FROM ends UNION ALL SELECT list_append(path, caller) FROM p JOIN flow ON path[-1] = callee WHERE len(path) < 10)"


def _back(t: Tables, every: bool) -> DataFrame:
    f = cut(_flow(t), "flow")
    ends = f.select(F.col("callee").alias("node")).join(f.select(F.col("caller").alias("node")), "node", "left_anti")
    return G.paths(f.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), ends, 10, every)


@query("g_paths_leaf_to_entry", FLOW + f", {_BACK} SELECT path FROM p")
def g_paths_leaf_to_entry(t):
    return _back(t, True)


@query("g_path_worthiness", FLOW + f", {_BACK} SELECT path, round(least(len(path), 8) * 0.5 + len(list_distinct(path)) / len(path) + CASE WHEN len(path) >= 4 THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM p")
def g_path_worthiness(t):
    n = F.size("path")
    score = F.least(n, F.lit(8)) * 0.5 + F.size(F.array_distinct("path")) / n + F.when(n >= 4, 1).otherwise(0)
    return _back(t, True).select("path", F.round(score, 6).alias("score"))


@query("g_pattern_chain", FLOW + f", {_FWD.format(n=4)} SELECT path FROM p WHERE len(path) = 4 ORDER BY path LIMIT 20")
def g_pattern_chain(t):
    f = cut(_flow(t), "flow")
    return G.paths(f.select("caller", "callee"), _starts(f), 4).where(F.size("path") == 4).orderBy("path").limit(20)


@query("g_function_nodes", FLOW + f", {_FWD.format(n=4)} SELECT path[1] AS entry, unnest(path) AS node, unnest(range(1, len(path) + 1)) AS step FROM p WHERE len(path) = 4")
def g_function_nodes(t):
    f = cut(_flow(t), "flow")
    p = G.paths(f.select("caller", "callee"), _starts(f), 4).where(F.size("path") == 4)
    return p.select(F.col("path")[0].alias("entry"), F.posexplode("path").alias("step", "node")).select("entry", "node", (F.col("step") + 1).cast("long").alias("step"))


_UP = "up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM extends UNION ALL SELECT u.child, e.parent, depth + 1 FROM up u JOIN extends e ON u.ancestor = e.child)"


@query("g_ancestors", RE + f", {_UP} SELECT * FROM up")
def g_ancestors(t):
    return G.closure(_extends(t))


@query("g_descendants", RE + f", {_UP} SELECT ancestor AS node, count(*) AS descendants FROM up GROUP BY 1")
def g_descendants(t):
    return G.closure(_extends(t)).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))


@query("g_depth", RE + f", {_UP} SELECT child AS node, max(depth) AS depth FROM up GROUP BY 1")
def g_depth(t):
    return G.closure(_extends(t)).groupBy(F.col("child").alias("node")).agg(F.max("depth").alias("depth"))


@query("g_inheritance_chain", RE + f", {_UP} SELECT child AS node, string_agg(ancestor, ' > ' ORDER BY depth) AS chain FROM up GROUP BY 1")
def g_inheritance_chain(t):
    c = G.closure(_extends(t)).groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("c"))
    return c.select("node", F.array_join(F.transform("c", lambda x: x["ancestor"]), " > ").alias("chain"))


@query("agg_inheritance_stats", RE + f", {_UP}, d AS (SELECT child, max(depth) AS depth FROM up GROUP BY 1) SELECT depth, count(*) AS n FROM d GROUP BY depth")
def agg_inheritance_stats(t):
    d = G.closure(_extends(t)).groupBy("child").agg(F.max("depth").alias("depth"))
    return d.groupBy("depth").agg(F.count("*").alias("n"))


@query("g_inherited_methods", RE + f", {_UP}, methods AS (SELECT r_name AS class, 'scope' AS name, 0 AS v FROM region UNION ALL SELECT n_name, 'scope', 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, 'base', 2 FROM region), inh AS (SELECT child, name, v, depth FROM up JOIN methods ON ancestor = class) SELECT child AS class, name, v FROM inh QUALIFY row_number() OVER (PARTITION BY child, name ORDER BY depth) = 1")
def g_inherited_methods(t):
    m = t.region.select(F.col("r_name").alias("ancestor"), F.lit("scope").alias("name"), F.lit(0).alias("v"))
    m = m.union(t.nation.where("n_nationkey % 2 = 0").select("n_name", F.lit("scope"), F.lit(1))).union(t.region.select("r_name", F.lit("base"), F.lit(2)))
    inh = G.closure(_extends(t)).join(m, "ancestor")
    return inh.groupBy(F.col("child").alias("class"), "name").agg(F.min_by("v", "depth").alias("v"))


@query("g_connected_components", RE + ", ways AS (SELECT child AS a, parent AS b FROM extends UNION SELECT parent, child FROM extends), reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a) SELECT a AS node, min(least(a, b)) AS comp FROM reach GROUP BY a")
def g_connected_components(t):
    return G.components(_extends(t).toDF("caller", "callee"))


def _lpa_sql(rounds: int) -> str:
    steps = "".join(f", v{k} AS (SELECT w.a AS node, l.label, count(*) AS n FROM ways w JOIN l{k - 1} l ON w.b = l.node GROUP BY ALL), l{k} AS (SELECT node, arg_max(label, (n, -label)) AS label FROM v{k} GROUP BY node)" for k in range(1, rounds + 1))
    return CALLS + f", ways AS (SELECT caller AS a, callee AS b FROM calls UNION SELECT callee, caller FROM calls), l0 AS (SELECT DISTINCT a AS node, a AS label FROM ways){steps} SELECT node, label FROM l{rounds}"


@query("g_community_lpa", _lpa_sql(5))
def g_community_lpa(t):
    return G.label_propagation(_calls(t), 5)


_IMPACT = "r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT {to}, depth + 1 FROM r JOIN calls ON node = {fr} WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"


@query("g_impact", RC + ", " + _IMPACT.format(to="caller", fr="callee") + " SELECT node, depth FROM d WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY depth ORDER BY node) <= CASE depth WHEN 1 THEN 300 WHEN 2 THEN 200 ELSE 100 END")
def g_impact(t):
    up = _calls(t).select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    d = G.bfs_levels(cut(up, "up"), _seed(t, 1), 3).where("depth > 0")
    n = F.row_number().over(W.partitionBy("depth").orderBy("node"))
    return d.withColumn("n", n).where("n <= case depth when 1 then 300 when 2 then 200 else 100 end").select("node", "depth")


@query("agg_impact_buckets", "SELECT count(*) AS total, sum((l_discount >= 0.09)::INT)::BIGINT AS high, sum((l_discount >= 0.05 AND l_discount < 0.09)::INT)::BIGINT AS medium, sum((l_discount < 0.05)::INT)::BIGINT AS low, CASE WHEN count(*) > 100 THEN 'critical' WHEN count(*) > 10 THEN 'high' ELSE 'low' END AS risk FROM lineitem WHERE l_partkey = 1")
def agg_impact_buckets(t):
    n = lambda c, name: F.sum(F.expr(c).cast("int")).alias(name)
    risk = F.when(F.count("*") > 100, "critical").when(F.count("*") > 10, "high").otherwise("low").alias("risk")
    return t.lineitem.where("l_partkey = 1").agg(F.count("*").alias("total"), n("l_discount >= 0.09", "high"), n("l_discount >= 0.05 and l_discount < 0.09", "medium"), n("l_discount < 0.05", "low"), risk)


@query("g_anchor_expand", RC + ", ways AS (SELECT caller AS a, callee AS b FROM calls UNION SELECT callee, caller FROM calls), r(node, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT 2::BIGINT, 0 UNION SELECT b, hop + 1 FROM r JOIN ways ON node = a WHERE hop < 2) SELECT node, min(hop) AS hop, round(greatest(0.05, 1 - 0.18 * min(hop)), 6)::DOUBLE AS score FROM r GROUP BY node")
def g_anchor_expand(t):
    e = _calls(t)
    both = cut(e.union(e.select("callee", "caller")).distinct(), "both")
    d = G.bfs_levels(both, _seed(t, 1, 2), 2)
    return d.select("node", F.col("depth").alias("hop"), F.round(F.greatest(F.lit(0.05), 1 - 0.18 * F.col("depth")), 6).alias("score"))


@query("g_trace_incoming", CALLS + ", first AS (SELECT callee AS node, min(caller) AS up FROM calls GROUP BY 1), top AS (SELECT callee AS node FROM calls GROUP BY 1 ORDER BY count(*) DESC, callee LIMIT 10) SELECT t.node, a.up AS up1, b.up AS up2, c.up AS up3 FROM top t LEFT JOIN first a ON t.node = a.node LEFT JOIN first b ON a.up = b.node LEFT JOIN first c ON b.up = c.node")
def g_trace_incoming(t):
    e = _calls(t)
    first = e.groupBy(F.col("callee").alias("node")).agg(F.min("caller").alias("up"))
    top = e.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(10).select("node")
    out = top.join(first.toDF("node", "up1"), "node", "left").join(first.toDF("up1", "up2"), "up1", "left").join(first.toDF("up2", "up3"), "up2", "left")
    return out.select("node", "up1", "up2", "up3")


_TIER = "CASE WHEN indeg >= 30 THEN 1.0 WHEN indeg >= 15 THEN 0.6 ELSE 0.2 END"


@query("g_entry_score_v1", CM + f", {_DEG}, {_SIDES}, ext AS (SELECT callee AS node, count(*) AS n FROM sides WHERE p1 <> p2 GROUP BY 1) SELECT d.node, round(0.3 * {_TIER} + 0.3 * least(1.0, coalesce(e.n, 0) / 5.0) + CASE WHEN p_name LIKE '%1%' THEN 0.2 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM degs d JOIN part ON d.node = p_partkey LEFT JOIN ext e ON e.node = d.node")
def g_entry_score_v1(t):
    e = _calls(t)
    ext = with_partitions(e, B.membership(t.part)).where("p1 <> p2").groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n"))
    x = degrees(e).join(t.part, F.col("node") == F.col("p_partkey")).join(ext, "node", "left")
    score = 0.3 * G.tiers(F.col("indeg"), [(30, 1.0), (15, 0.6)], 0.2) + 0.3 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 5.0) + F.when(F.col("p_name").like("%1%"), 0.2).otherwise(0.0) + F.when(F.col("p_size") > 25, 0.2).otherwise(0.0)
    return x.select("node", F.round(score, 6).alias("score"))


@query("g_entry_score_v2", CM + f", {_DEG}, {_SIDES}, ext AS (SELECT callee AS node, count(*) AS n FROM sides WHERE p1 <> p2 GROUP BY 1) SELECT d.node, round(0.30 * (outdeg / (outdeg + indeg)) + CASE WHEN p_name LIKE '%1%' THEN 0.20 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.20 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL%' THEN 0.20 ELSE 0 END + 0.10 * least(1.0, coalesce(e.n, 0) / 5.0), 6)::DOUBLE AS score FROM degs d JOIN part ON d.node = p_partkey LEFT JOIN ext e ON e.node = d.node WHERE p_name NOT LIKE '%test%'")
def g_entry_score_v2(t):
    e = _calls(t)
    ext = with_partitions(e, B.membership(t.part)).where("p1 <> p2").groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n"))
    x = degrees(e).join(t.part, F.col("node") == F.col("p_partkey")).where(~F.col("p_name").contains("test")).join(ext, "node", "left")
    flag = lambda c: F.when(c, 0.20).otherwise(0.0)
    score = 0.30 * (F.col("outdeg") / (F.col("outdeg") + F.col("indeg"))) + flag(F.col("p_name").like("%1%")) + flag(F.col("p_size") % 2 == 0) + flag(F.col("p_type").like("%STEEL%")) + 0.10 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 5.0)
    return x.select("node", F.round(score, 6).alias("score"))


@query("g_entry_score_v3", CALLS + f", {_DEG} SELECT node, round(outdeg / (indeg + 1.0) * CASE WHEN p_size > 25 THEN 2.0 ELSE 1.0 END * CASE WHEN p_name LIKE '%1%' THEN 1.5 WHEN p_name LIKE '%2%' THEN 0.3 ELSE 1.0 END, 6)::DOUBLE AS score FROM degs JOIN part ON node = p_partkey")
def g_entry_score_v3(t):
    x = degrees(_calls(t)).join(t.part, F.col("node") == F.col("p_partkey"))
    name = F.when(F.col("p_name").like("%1%"), 1.5).when(F.col("p_name").like("%2%"), 0.3).otherwise(1.0)
    return x.select("node", F.round(F.col("outdeg") / (F.col("indeg") + 1.0) * F.when(F.col("p_size") > 25, 2.0).otherwise(1.0) * name, 6).alias("score"))


@query("agg_entry_stats", CALLS + f", {_DEG}, s AS (SELECT outdeg / (outdeg + indeg) AS s FROM degs) SELECT round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score, round(min(s), 6) AS min_score, sum((s >= 0.8)::INT)::BIGINT AS high, sum((s >= 0.5 AND s < 0.8)::INT)::BIGINT AS medium, sum((s < 0.5)::INT)::BIGINT AS low FROM s")
def agg_entry_stats(t):
    s = degrees(_calls(t)).select((F.col("outdeg") / (F.col("outdeg") + F.col("indeg"))).alias("s"))
    n = lambda c, name: F.sum(F.expr(c).cast("int")).alias(name)
    return s.agg(F.round(F.avg("s"), 6).alias("avg_score"), F.round(F.max("s"), 6).alias("max_score"), F.round(F.min("s"), 6).alias("min_score"), n("s >= 0.8", "high"), n("s >= 0.5 and s < 0.8", "medium"), n("s < 0.5", "low"))


@query("filter_threshold_entries", CALLS + f", {_DEG} SELECT node FROM degs WHERE outdeg / (outdeg + indeg) >= 0.5")
def filter_threshold_entries(t):
    return degrees(_calls(t)).where("outdeg / (outdeg + indeg) >= 0.5").select("node")


@query("g_process_traces", RC + ", few AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY caller ORDER BY callee) <= 2), p(path) AS (SELECT [1::BIGINT] UNION ALL SELECT list_append(path, callee) FROM p JOIN few ON path[-1] = caller WHERE len(path) < 6 AND NOT list_contains(path, callee)) SELECT path FROM p x WHERE len(path) = 6 OR NOT EXISTS (SELECT 1 FROM few f WHERE f.caller = x.path[-1] AND NOT list_contains(x.path, f.callee))")
def g_process_traces(t):
    return G.traces(_calls(t), _seed(t, 1), 6, 2)


@query("g_process_bfs", FLOW + ", starts AS (SELECT part, caller AS node FROM flow WHERE caller NOT IN (SELECT callee FROM flow)), r(part, node, step) AS (SELECT part, node, 1 FROM starts UNION ALL SELECT r.part, callee, step + 1 FROM r JOIN flow ON node = caller WHERE step < 60) SELECT part, node, step FROM r")
def g_process_bfs(t):
    f = cut(_flow(t), "flow")
    d = G.bfs_levels(f.select("caller", "callee"), _starts(f), 59)
    parts = f.select("part", F.col("caller").alias("node")).union(f.select("part", "callee")).distinct()
    return d.join(parts, "node").select("part", "node", (F.col("depth") + 1).alias("step"))


_PATHS = "segs AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages), pre AS (SELECT page_id, array_to_string(s[:n], '/') AS path, n, len(s) AS k FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS n FROM segs))"


def _prefixes(t: Tables) -> DataFrame:
    s = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    x = t.pages.select("page_id", s.alias("s")).select("page_id", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    return x.select("page_id", F.array_join(F.slice("s", 1, F.col("n")), "/").alias("path"), "n", F.size("s").alias("k"))


@query("agg_folder_tree", f"WITH {_PATHS} SELECT path, count(DISTINCT page_id) AS files FROM pre WHERE n < k GROUP BY path")
def agg_folder_tree(t):
    return _prefixes(t).where("n < k").groupBy("path").agg(F.count_distinct("page_id").alias("files"))


@query("g_structure", f"WITH {_PATHS} SELECT DISTINCT a.path AS parent, b.path AS child FROM pre a JOIN pre b ON a.page_id = b.page_id AND b.n = a.n + 1")
def g_structure(t):
    p = _prefixes(t)
    return p.withColumn("child", F.lead("path").over(W.partitionBy("page_id").orderBy("n"))).where("child is not null").select(F.col("path").alias("parent"), "child").distinct()


@query("join_contains", "SELECT 'region' AS kind, r_name AS source, n_name AS target FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'customer', n_name, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier', n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def join_contains(t):
    n = F.broadcast(t.nation)
    a = t.region.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("region").alias("kind"), F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    b = t.customer.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lit("customer"), "n_name", "c_name")
    c = t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.lit("supplier"), "n_name", "s_name")
    return a.union(b).union(c)


@query("join_optional_neighbors", CALLS + "SELECT node, coalesce(o, 0) AS out_n, coalesce(i, 0) AS in_n FROM (SELECT p_partkey AS node FROM part) LEFT JOIN (SELECT caller AS node, count(*) AS o FROM calls GROUP BY 1) USING (node) LEFT JOIN (SELECT callee AS node, count(*) AS i FROM calls GROUP BY 1) USING (node)")
def join_optional_neighbors(t):
    d = degrees(_calls(t))
    return t.part.select(F.col("p_partkey").alias("node")).join(d, "node", "left").select("node", F.coalesce("outdeg", F.lit(0)).alias("out_n"), F.coalesce("indeg", F.lit(0)).alias("in_n"))


@query("join_intermediate", FLOW + ", two AS (SELECT a.caller AS x, a.callee AS m, b.callee AS y FROM flow a JOIN flow b ON a.callee = b.caller) SELECT x, m, y FROM two WHERE NOT EXISTS (SELECT 1 FROM flow f WHERE f.caller = x AND f.callee = y)")
def join_intermediate(t):
    f = _flow(t).select("caller", "callee")
    two = f.toDF("x", "m").join(f.toDF("m", "y"), "m")
    return two.join(f.toDF("x", "y"), ["x", "y"], "left_anti").select("x", "m", "y")


@query("join_main_method", CALLS + ", hubs AS (SELECT caller, count(*) AS n FROM calls GROUP BY 1) SELECT caller AS method, n FROM hubs WHERE n >= 2 AND caller NOT IN (SELECT callee FROM calls)")
def join_main_method(t):
    e = _calls(t)
    hubs = e.groupBy(F.col("caller").alias("method")).agg(F.count("*").alias("n")).where("n >= 2")
    return hubs.join(e.select(F.col("callee").alias("method")), "method", "left_anti")


@query("g_node_sizes", CALLS + f", {_DEG} SELECT node, (20 + 2 * (indeg + outdeg))::BIGINT AS size FROM degs")
def g_node_sizes(t):
    return degrees(_calls(t)).select("node", (20 + 2 * (F.col("indeg") + F.col("outdeg"))).alias("size"))


@query("g_edge_widths", CM + f", {_SIDES}, w AS (SELECT p1, p2, count(*) AS n FROM sides WHERE p1 <> p2 GROUP BY ALL) SELECT p1, p2, round(1 + 4.0 * n / (SELECT max(n) FROM w), 6)::DOUBLE AS width FROM w")
def g_edge_widths(t):
    w = cut(with_partitions(_calls(t), B.membership(t.part)).where("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("n")), "widths")
    top = F.broadcast(w.agg(F.max("n").alias("m")))
    return w.join(top).select("p1", "p2", F.round(1 + 4.0 * F.col("n") / F.col("m"), 6).alias("width"))


@query("g_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.85 WHEN 'R' THEN 0.5 ELSE 0.3 END * CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.9 END, 6)::DOUBLE AS confidence FROM lineitem")
def g_confidence(t):
    base = F.create_map(*[F.lit(x) for kv in {"A": 0.9, "N": 0.85, "R": 0.5}.items() for x in kv])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.coalesce(base[F.col("l_returnflag")], F.lit(0.3)) * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.9), 6).alias("confidence"))


@query("g_hypergraph_build", CALLS + "SELECT 'fanout' AS kind, caller AS hub, count(*) AS n FROM calls GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'fanin', callee, count(*) FROM calls GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'cycle', x.caller, count(*) FROM calls x JOIN calls y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee GROUP BY 2")
def g_hypergraph_build(t):
    e = _calls(t)
    part = lambda df, kind, hub: df.groupBy(F.col(hub).alias("hub")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "hub", "n")
    return part(e, "fanout", "caller").where("n >= 3").union(part(e, "fanin", "callee").where("n >= 3")).union(part(G.mutual(e), "cycle", "a"))
