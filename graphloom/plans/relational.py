"""Queries of scans, filters, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.operators import ledger as L
from graphloom.operators import ranking as R
from graphloom.plans.book import Tables, query
from graphloom.sources import bindings as B
from graphloom.sources.bindings import with_

LED, LOG, CALLS = with_("ledger"), with_("log"), with_("calls")


def _ledger(t: Tables) -> DataFrame:
    return B.ledger(t.orders)


# ---- ledger -----------------------------------------------------------------


@query("agg_balance", LED + "SELECT (sum(CASE WHEN type = 'income' THEN amount ELSE -amount END))::DOUBLE AS balance FROM ledger")
def agg_balance(t):
    return L.balance(_ledger(t))


@query("agg_income", LED + "SELECT sum(amount)::DOUBLE AS total FROM ledger WHERE type = 'income'")
def agg_income(t):
    return L.total(_ledger(t), "income")


@query("agg_expense", LED + "SELECT sum(amount)::DOUBLE AS total FROM ledger WHERE type = 'expense'")
def agg_expense(t):
    return L.total(_ledger(t), "expense")


@query("agg_summary", LED + "SELECT category, sum(CASE WHEN type = 'income' THEN amount ELSE 0 END)::DOUBLE AS income, sum(CASE WHEN type = 'expense' THEN amount ELSE 0 END)::DOUBLE AS expense, count(*) AS n FROM ledger GROUP BY GROUPING SETS ((), (category))")
def agg_summary(t):
    return L.summary(_ledger(t))


@query("agg_group_collect", LED + "SELECT coalesce(category, '未分类') AS category, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ledger GROUP BY 1")
def agg_group_collect(t):
    return _ledger(t).groupBy(F.coalesce("category", F.lit("未分类")).alias("category")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("agg_distinct_categories", LED + "SELECT DISTINCT category FROM ledger")
def agg_distinct_categories(t):
    return _ledger(t).select("category").distinct()


@query("filter_date_range", LED + "SELECT id, date FROM ledger WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def filter_date_range(t):
    return L.filtered(_ledger(t), "1995-01-01", "1995-12-31").select("id", "date")


@query("filter_category", LED + "SELECT id FROM ledger WHERE category = '1-URGENT'")
def filter_category(t):
    return L.filtered(_ledger(t), category="1-URGENT").select("id")


@query("filter_type", LED + "SELECT id FROM ledger WHERE type = 'income'")
def filter_type(t):
    return L.filtered(_ledger(t), kind="income").select("id")


@query("filter_conjunctive_list", LED + "SELECT id, date, amount::DOUBLE AS amount FROM ledger WHERE date >= DATE '1994-01-01' AND category = '2-HIGH' AND type = 'expense' ORDER BY date DESC, id LIMIT 50")
def filter_conjunctive_list(t):
    return L.filtered(_ledger(t), start="1994-01-01", category="2-HIGH", kind="expense").orderBy(F.desc("date"), "id").limit(50).select("id", "date", F.col("amount").cast("double").alias("amount"))


@query("project_fields", LED + "SELECT id, category, CAST(NULL AS VARCHAR) AS note FROM ledger")
def project_fields(t):
    return L.projected(_ledger(t), ["id", "category", "note"])


@query("q_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def q_point_lookup(t):
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("q_upsert_delete", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 7")
def q_upsert_delete(t):
    new = t.nation.where("n_nationkey < 5").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    return L.upserted(t.nation.select("n_nationkey", "n_name"), new, "n_nationkey").where("n_nationkey <> 7")


@query("q_library_overview", LED + "SELECT date, type, count(*) AS n, sum(amount)::DOUBLE AS total FROM ledger GROUP BY ALL")
def q_library_overview(t):
    return _ledger(t).groupBy("date", "type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


# ---- events -----------------------------------------------------------------


def _log(t: Tables) -> DataFrame:
    return B.event_log(t.events)


@query("win_event_seq", LOG + "SELECT key, seq, event_id FROM log")
def win_event_seq(t):
    return _log(t).select("key", "seq", "event_id")


@query("win_last_k", LOG + "SELECT key, event_id FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 5")
def win_last_k(t):
    return R.last_k(_log(t), "key", [F.desc("seq")], 5).select("key", "event_id")


@query("filter_event_log", LOG + "SELECT key, event_id FROM log WHERE type = 'error' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 3")
def filter_event_log(t):
    return R.last_k(_log(t).where("type = 'error'"), "key", [F.desc("seq")], 3).select("key", "event_id")


@query("filter_agent_context", LOG + "SELECT key, type, event_id FROM log WHERE type IN ('error', 'purchase') QUALIFY row_number() OVER (PARTITION BY key, type ORDER BY seq DESC) <= 5")
def filter_agent_context(t):
    some = _log(t).where(F.col("type").isin("error", "purchase"))
    return some.withColumn("n", F.row_number().over(W.partitionBy("key", "type").orderBy(F.desc("seq")))).where("n <= 5").select("key", "type", "event_id")


@query("agg_error_stats", "SELECT user_id, count(*) AS total, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::BIGINT AS resolved, round(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM events WHERE event_type = 'error' GROUP BY user_id")
def agg_error_stats(t):
    done = F.sum(F.when(F.col("value") < 50, 1).otherwise(0))
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("total"), done.alias("resolved"), F.round(done / F.count("*"), 6).alias("rate"))


@query("q_status_counts", "SELECT event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS status, count(*) AS n FROM events GROUP BY ALL")
def q_status_counts(t):
    return t.events.groupBy("event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("status")).agg(F.count("*").alias("n"))


@query("q_event_timeline", "SELECT event_id, user_id, ts, coalesce(props ->> '$.k', event_type) AS summary FROM events WHERE event_type IN ('signup', 'error')")
def q_event_timeline(t):
    return t.events.where(F.col("event_type").isin("signup", "error")).select("event_id", "user_id", "ts", F.coalesce(F.get_json_object("props", "$.k"), F.col("event_type")).alias("summary"))


@query("st_cursor_read", LOG + "SELECT key, seq, event_id FROM log WHERE seq > 10 AND seq <= 60")
def st_cursor_read(t):
    return _log(t).where((F.col("seq") > 10) & (F.col("seq") <= 60)).select("key", "seq", "event_id")


@query("win_round_trip_retry", "SELECT event_type, event_id FROM (SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type, user_id) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 12")
def win_round_trip_retry(t):
    newest = t.events.groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return R.capped(newest, "event_type", [F.desc("ts"), F.col("event_id")], 12).select("event_type", "event_id")


@query("q_recent_files", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 20")
def q_recent_files(t):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id").limit(20)


@query("q_consensus", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def q_consensus(t):
    votes = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.first_wins(votes, ["user_id"], [F.desc("n"), F.col("event_type")])


@query("fn_json_props", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def fn_json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_backoff", "SELECT event_id, least(pow(2, event_id % 10), 60)::DOUBLE AS seconds FROM events")
def fn_backoff(t):
    return t.events.select("event_id", F.least(F.pow(F.lit(2.0), F.col("event_id") % 10), F.lit(60.0)).alias("seconds"))


# ---- calls: filters, degrees, roll-ups ---------------------------------------


def _calls(t: Tables) -> DataFrame:
    return B.calls(t.lineitem)


def _members(t: Tables) -> DataFrame:
    return B.membership(t.part)


CM = with_("calls", "member")
CL = with_("calls", "location")


@query("g_reverse", CALLS + "SELECT callee AS caller, caller AS callee FROM calls")
def g_reverse(t):
    return _calls(t).select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


@query("g_neighbors_out", CALLS + "SELECT callee FROM calls WHERE caller = 1")
def g_neighbors_out(t):
    return _calls(t).where("caller = 1").select("callee")


@query("g_neighbors_in", CALLS + "SELECT caller FROM calls WHERE callee = 1")
def g_neighbors_in(t):
    return _calls(t).where("callee = 1").select("caller")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outdeg, indeg) of every node with an edge, by one shuffle of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("outdeg"), F.sum("x.i").alias("indeg"))


_DEG = "degs AS (SELECT node, sum(o)::BIGINT AS outdeg, sum(i)::BIGINT AS indeg FROM (SELECT caller AS node, 1 AS o, 0 AS i FROM calls UNION ALL SELECT callee, 0, 1 FROM calls) GROUP BY node)"


@query("agg_degrees", CALLS + f", {_DEG} SELECT * FROM degs")
def agg_degrees(t):
    return degrees(_calls(t))


@query("agg_degree_extremes", CALLS + f", {_DEG} SELECT count(*) AS nodes, sum(outdeg)::BIGINT AS edges, round(avg(outdeg), 6) AS avg_out, arg_max(node, (indeg, -node)) AS most_called, arg_max(node, (outdeg, -node)) AS most_calling FROM degs")
def agg_degree_extremes(t):
    d = degrees(_calls(t))
    return d.agg(F.count("*").alias("nodes"), F.sum("outdeg").alias("edges"), F.round(F.avg("outdeg"), 6).alias("avg_out"), F.max_by("node", F.struct("indeg", -F.col("node"))).alias("most_called"), F.max_by("node", F.struct("outdeg", -F.col("node"))).alias("most_calling"))


@query("agg_most_called", CALLS + "SELECT callee, count(DISTINCT caller) AS n FROM calls GROUP BY callee ORDER BY n DESC, callee LIMIT 10")
def agg_most_called(t):
    return _calls(t).groupBy("callee").agg(F.count("caller").alias("n")).orderBy(F.desc("n"), "callee").limit(10)


@query("agg_call_frequency", "SELECT l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, node LIMIT 20")
def agg_call_frequency(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(20)


@query("agg_hotspots", CALLS + f", {_DEG} SELECT node, indeg + outdeg AS degree FROM degs ORDER BY degree DESC, node LIMIT 8")
def agg_hotspots(t):
    return degrees(_calls(t)).select("node", (F.col("indeg") + F.col("outdeg")).alias("degree")).orderBy(F.desc("degree"), "node").limit(8)


@query("topk_degree_sample", CALLS + f", {_DEG}, top AS (SELECT node FROM degs ORDER BY indeg + outdeg DESC, node LIMIT 200) SELECT c.* FROM calls c WHERE caller IN (SELECT node FROM top) AND callee IN (SELECT node FROM top)")
def topk_degree_sample(t):
    edges = _calls(t)
    top = degrees(edges).orderBy(F.desc(F.col("indeg") + F.col("outdeg")), "node").limit(200).select("node")
    return edges.join(top.withColumnRenamed("node", "caller"), "caller", "left_semi").join(top.withColumnRenamed("node", "callee"), "callee", "left_semi").select("caller", "callee")


@query("g_roots", CALLS + "SELECT DISTINCT caller AS node FROM calls WHERE caller NOT IN (SELECT callee FROM calls)")
def g_roots(t):
    e = _calls(t)
    return e.select(F.col("caller").alias("node")).distinct().join(e.select(F.col("callee").alias("node")), "node", "left_anti")


@query("g_leaves", CALLS + "SELECT DISTINCT callee AS node FROM calls WHERE callee NOT IN (SELECT caller FROM calls)")
def g_leaves(t):
    e = _calls(t)
    return e.select(F.col("callee").alias("node")).distinct().join(e.select(F.col("caller").alias("node")), "node", "left_anti")


def with_partitions(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with the partitions of both ends."""
    p = members.select("node", "part")
    return edges.join(p.toDF("caller", "p1"), "caller").join(p.toDF("callee", "p2"), "callee")


_SIDES = "sides AS (SELECT c.*, a.part AS p1, b.part AS p2, a.func AS f1, b.func AS f2 FROM calls c JOIN member a ON caller = a.node JOIN member b ON callee = b.node)"
_QUALITY = f"{_SIDES}, quality AS (SELECT part, (SELECT count(*) FROM sides WHERE p1 = part AND p2 = part) AS internal, (SELECT count(*) FROM sides WHERE (p1 = part) <> (p2 = part)) AS external, (SELECT count(*) FROM member m WHERE m.part = x.part) AS size FROM (SELECT DISTINCT part FROM member) x)"


def partition_quality(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(part, internal, external, size, modularity): calls inside and across, their share inside."""
    e = with_partitions(edges, members)
    sides = e.select(F.explode(F.expr("if(p1 = p2, array(named_struct('part', p1, 'i', 1, 'e', 0)), array(named_struct('part', p1, 'i', 0, 'e', 1), named_struct('part', p2, 'i', 0, 'e', 1)))")).alias("x"))
    q = sides.groupBy("x.part").agg(F.sum("x.i").alias("internal"), F.sum("x.e").alias("external"))
    out = members.groupBy("part").agg(F.count("*").alias("size")).join(q, "part", "left").na.fill(0, ["internal", "external"])
    return out.withColumn("modularity", F.when(F.col("internal") + F.col("external") > 0, F.round(F.col("internal") / (F.col("internal") + F.col("external")), 6)).otherwise(0.0))


_MOD = "CASE WHEN internal + external > 0 THEN round(internal / (internal + external), 6) ELSE 0.0 END"


@query("agg_partition_quality", CM + f", {_QUALITY} SELECT *, {_MOD} AS modularity FROM quality")
def agg_partition_quality(t):
    return partition_quality(_calls(t), _members(t))


@query("agg_partition_stats", CM + f", {_QUALITY} SELECT count(*) AS partitions, round(avg(m), 6) AS avg_modularity, max(m) AS max_modularity, min(m) AS min_modularity, round(avg(size), 6) AS avg_size FROM (SELECT *, {_MOD} AS m FROM quality)")
def agg_partition_stats(t):
    q = partition_quality(_calls(t), _members(t))
    return q.agg(F.count("*").alias("partitions"), F.round(F.avg("modularity"), 6).alias("avg_modularity"), F.max("modularity").alias("max_modularity"), F.min("modularity").alias("min_modularity"), F.round(F.avg("size"), 6).alias("avg_size"))


@query("agg_community_quality", CM + f", {_QUALITY} SELECT round(avg(m), 4) AS cohesion, round(avg((size = 1)::INT), 4) AS singletons FROM (SELECT *, {_MOD} AS m FROM quality)")
def agg_community_quality(t):
    q = partition_quality(_calls(t), _members(t))
    return q.agg(F.round(F.avg("modularity"), 4).alias("cohesion"), F.round(F.avg((F.col("size") == 1).cast("int")), 4).alias("singletons"))


@query("agg_density_cohesion", CM + f", {_SIDES}, und AS (SELECT DISTINCT p1 AS part, least(caller, callee) AS a, greatest(caller, callee) AS b FROM sides WHERE p1 = p2), sizes AS (SELECT part, count(*) AS n FROM member GROUP BY part) SELECT s.part, CASE WHEN n = 1 THEN 1.0 ELSE round(least(1.0, count(a) / (n * (n - 1) / 2.0)), 6) END AS cohesion FROM sizes s LEFT JOIN und u ON s.part = u.part GROUP BY s.part, n")
def agg_density_cohesion(t):
    e = with_partitions(_calls(t), _members(t)).where("p1 = p2").select(F.col("p1").alias("part"), F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).distinct()
    sizes = _members(t).groupBy("part").agg(F.count("*").alias("n"))
    inner = e.groupBy("part").agg(F.count("*").alias("k"))
    share = F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2.0))
    return sizes.join(inner, "part", "left").select("part", F.when(F.col("n") == 1, 1.0).otherwise(F.round(share, 6)).alias("cohesion"))


@query("join_partition_internal_external", CM + ", p AS (SELECT node FROM member WHERE part = 'Brand#11') SELECT caller, callee, callee IN (SELECT node FROM p) AS internal FROM calls WHERE caller IN (SELECT node FROM p)")
def join_partition_internal_external(t):
    p = _members(t).where("part = 'Brand#11'").select("node")
    mine = _calls(t).join(p.toDF("caller"), "caller", "left_semi")
    return mine.join(p.select(F.col("node").alias("callee"), F.lit(True).alias("hit")), "callee", "left").select("caller", "callee", F.coalesce("hit", F.lit(False)).alias("internal"))


@query("join_folder_rollup", CM + f", {_SIDES} SELECT p1, p2, count(*) AS weight FROM sides WHERE p1 <> p2 GROUP BY ALL")
def join_folder_rollup(t):
    return with_partitions(_calls(t), _members(t)).where("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("weight"))


@query("join_function_rollup", CM + f", {_SIDES}, sizes AS (SELECT func, count(*) AS n FROM member GROUP BY 1) SELECT f1, f2, count(*) AS calls, round(count(*) / greatest(1, max(n)), 6) AS density FROM sides JOIN sizes ON f1 = func WHERE f1 <> f2 GROUP BY f1, f2")
def join_function_rollup(t):
    f = _members(t).select("node", "func")
    e = _calls(t).join(f.toDF("caller", "f1"), "caller").join(f.toDF("callee", "f2"), "callee").where("f1 <> f2")
    sizes = f.groupBy(F.col("func").alias("f1")).agg(F.count("*").alias("n"))
    out = e.groupBy("f1", "f2").agg(F.count("*").alias("calls")).join(sizes, "f1")
    return out.select("f1", "f2", "calls", F.round(F.col("calls") / F.greatest(F.lit(1), F.col("n")), 6).alias("density"))


@query("join_cluster_deps", CM + f", {_SIDES} SELECT p1, p2, count(*) AS n FROM sides WHERE p1 <> p2 GROUP BY ALL ORDER BY n DESC, p1, p2 LIMIT 15")
def join_cluster_deps(t):
    return with_partitions(_calls(t), _members(t)).where("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p1", "p2").limit(15)


@query("join_external_callers", CM + f", {_SIDES} SELECT callee AS node, count(*) AS external FROM sides WHERE p1 <> p2 GROUP BY 1")
def join_external_callers(t):
    return with_partitions(_calls(t), _members(t)).where("p1 <> p2").groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("external"))


@query("join_cross_file", CL + "SELECT caller, callee, a.file AS from_file, b.file AS to_file FROM calls JOIN location a ON caller = a.node JOIN location b ON callee = b.node WHERE a.file <> b.file")
def join_cross_file(t):
    loc = B.location(t.lineitem)
    return _calls(t).join(loc.toDF("caller", "from_file"), "caller").join(loc.toDF("callee", "to_file"), "callee").where("from_file <> to_file").select("caller", "callee", "from_file", "to_file")


_COUPLE = "pairs AS (SELECT DISTINCT a.file AS f, b.file AS g FROM calls JOIN location a ON caller = a.node JOIN location b ON callee = b.node WHERE a.file <> b.file), couple AS (SELECT coalesce(o.f, i.g) AS file, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM (SELECT f, count(*) AS n FROM pairs GROUP BY f) o FULL JOIN (SELECT g, count(*) AS n FROM pairs GROUP BY g) i ON o.f = i.g)"


def coupling(t: Tables) -> DataFrame:
    loc = B.location(t.lineitem)
    pairs = _calls(t).join(loc.toDF("caller", "f"), "caller").join(loc.toDF("callee", "g"), "callee").where("f <> g").select(F.col("f").alias("caller"), F.col("g").alias("callee")).distinct()
    return degrees(pairs).select(F.col("node").alias("file"), F.col("outdeg").alias("outgoing"), F.col("indeg").alias("incoming"))


@query("agg_file_coupling", CL + f", {_COUPLE} SELECT * FROM couple")
def agg_file_coupling(t):
    return coupling(t)


@query("agg_cross_file_stats", CL + f", {_COUPLE} SELECT count(*) AS files, max(outgoing) AS max_out, max(incoming) AS max_in, arg_max(file, (outgoing, -file)) AS most_out, arg_max(file, (incoming, -file)) AS most_in FROM couple")
def agg_cross_file_stats(t):
    return coupling(t).agg(F.count("*").alias("files"), F.max("outgoing").alias("max_out"), F.max("incoming").alias("max_in"), F.max_by("file", F.struct("outgoing", -F.col("file"))).alias("most_out"), F.max_by("file", F.struct("incoming", -F.col("file"))).alias("most_in"))


@query("agg_module_deps", CM + f", {_SIDES} SELECT p1 AS module, count(DISTINCT p2) AS deps FROM sides WHERE p1 <> p2 GROUP BY 1")
def agg_module_deps(t):
    return with_partitions(_calls(t), _members(t)).where("p1 <> p2").groupBy(F.col("p1").alias("module")).agg(F.size(F.collect_set("p2")).cast("long").alias("deps"))


@query("agg_layer_stats", "SELECT p_type, p_brand, count(*) AS n, sum((p_size < 10)::INT)::BIGINT AS small, sum((p_size >= 10)::INT)::BIGINT AS large FROM part GROUP BY ROLLUP (p_type, p_brand)")
def agg_layer_stats(t):
    return t.part.rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.sum((F.col("p_size") < 10).cast("int")).alias("small"), F.sum((F.col("p_size") >= 10).cast("int")).alias("large"))


@query("agg_summary_report", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_summary_report(t):
    x = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("agg_node_stats", "SELECT b.kind, coalesce(n, 0) AS n FROM (VALUES ('signup'), ('purchase'), ('error'), ('view'), ('click'), ('other')) b(kind) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON b.kind = e.event_type")
def agg_node_stats(t):
    kinds = t.spark.createDataFrame([(k,) for k in ("signup", "purchase", "error", "view", "click", "other")], "kind string")
    n = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "kind", "left").na.fill(0, ["n"])


@query("agg_codebase_stats", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def agg_codebase_stats(t):
    return t.documents.groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))


@query("agg_repo_stats", CM + "SELECT (SELECT count(*) FROM location_count) AS files, (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM calls) AS edges, (SELECT count(DISTINCT part) FROM member) AS communities".replace("location_count", "(SELECT DISTINCT l_suppkey FROM lineitem)"))
def agg_repo_stats(t):
    files, nodes = t.lineitem.agg(F.count_distinct("l_suppkey").alias("files")), t.part.agg(F.count("*").alias("nodes"), F.count_distinct("p_brand").alias("communities"))
    return files.join(nodes).join(_calls(t).agg(F.count("*").alias("edges"))).select("files", "nodes", "edges", "communities")


@query("g_edge_weight", CALLS + f", {_DEG} SELECT caller, callee, round(1 + 0.2 * least(b.outdeg, 5) + CASE WHEN a.outdeg = 1 THEN 0.3 ELSE 0 END + CASE WHEN b.indeg = 1 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS weight FROM calls JOIN degs a ON caller = a.node JOIN degs b ON callee = b.node")
def g_edge_weight(t):
    e = _calls(t)
    d = degrees(e)
    x = e.join(d.toDF("caller", "co", "ci"), "caller").join(d.toDF("callee", "do", "di"), "callee")
    w = F.lit(1.0) + 0.2 * F.least(F.col("do"), F.lit(5)) + F.when(F.col("co") == 1, 0.3).otherwise(0.0) + F.when(F.col("di") == 1, 0.3).otherwise(0.0)
    return x.select("caller", "callee", F.round(w, 6).alias("weight"))


@query("filter_orphan_edges", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def filter_orphan_edges(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("filter_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount IS NULL OR l_discount >= 0.03")
def filter_confidence(t):
    return t.lineitem.where("l_discount is null or l_discount >= 0.03").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query("filter_rel_type_in", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_tax IS NULL OR l_tax >= 0.04)")
def filter_rel_type_in(t):
    return t.lineitem.where(F.col("l_returnflag").isin("A", "R") & (F.col("l_tax").isNull() | (F.col("l_tax") >= 0.04))).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- ranking ------------------------------------------------------------------


@query("win_final_rank", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 100")
def win_final_rank(t):
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    return t.part.orderBy(*order).limit(100).select("p_partkey", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


@query("win_per_file_cap", "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2")
def win_per_file_cap(t):
    return R.capped(t.part, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 2).select("p_partkey", "p_brand")


@query("win_first_wins", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def win_first_wins(t):
    return R.first_wins(t.part, ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("win_diversify", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_partkey, row_number() OVER (ORDER BY (n > 1)::INT, p_retailprice DESC, p_partkey) AS pick FROM r ORDER BY pick LIMIT 40")
def win_diversify(t):
    return R.diversified(t.part, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 40).select("p_partkey", F.col("pick").cast("long").alias("pick"))


@query("win_representative_paths", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS n FROM part), s AS (SELECT *, row_number() OVER (ORDER BY (n > 1)::INT, p_size DESC, p_partkey) AS pick FROM r) SELECT p_partkey, CASE WHEN pick <= 100 THEN 'selected' ELSE 'deferred' END AS status FROM s WHERE pick <= 200")
def win_representative_paths(t):
    return R.diversified(t.part, "p_type", [F.desc("p_size"), F.col("p_partkey")], 200).select("p_partkey", F.when(F.col("pick") <= 100, "selected").otherwise("deferred").alias("status"))


@query("win_dynamic_k", "WITH r AS (SELECT p_partkey, p_retailprice AS s, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), k AS (SELECT greatest(5, least(50, (SELECT count(*) FROM r WHERE s >= 0.95 * (SELECT max(s) FROM r)))) AS k) SELECT p_partkey, rank FROM r, k WHERE rank <= k")
def win_dynamic_k(t):
    return R.dynamic_k(t.part, "p_retailprice", [F.desc("p_retailprice"), F.col("p_partkey")], 0.95, 5, 50).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("win_round_robin_sample", "SELECT p_partkey FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) ORDER BY turn, p_brand LIMIT 60")
def win_round_robin_sample(t):
    return R.round_robin(t.part, "p_brand", [F.col("p_partkey")], 60).select("p_partkey")


@query("win_best_path", "SELECT p_type, max(p_retailprice) AS best, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey FROM part GROUP BY p_type ORDER BY best DESC, p_type LIMIT 24")
def win_best_path(t):
    return t.part.groupBy("p_type").agg(F.max("p_retailprice").alias("best"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("p_partkey")).orderBy(F.desc("best"), "p_type").limit(24)


@query("win_rank_partitions", CM + f", {_QUALITY} SELECT part, row_number() OVER (ORDER BY m DESC, size DESC, internal DESC, part) AS rank FROM (SELECT *, {_MOD} AS m FROM quality)")
def win_rank_partitions(t):
    order = W.orderBy(F.desc("modularity"), F.desc("size"), F.desc("internal"), "part")
    return partition_quality(_calls(t), _members(t)).select("part", F.row_number().over(order).cast("long").alias("rank"))


@query("topk_multi_key", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_brand, -length(p_name) DESC, p_partkey LIMIT 30")
def topk_multi_key(t):
    return t.part.orderBy(F.desc("p_size"), "p_brand", F.desc(-F.length("p_name")), "p_partkey").limit(30).select("p_partkey")


@query("topk_clusters", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 200")
def topk_clusters(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(200)


@query("topk_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def topk_recent(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")


@query("topk_critical", "SELECT o_custkey, count(*) AS steps FROM orders GROUP BY 1 ORDER BY steps DESC, o_custkey LIMIT 10")
def topk_critical(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("steps")).orderBy(F.desc("steps"), "o_custkey").limit(10)


@query("win_lead_edges", "SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders QUALIFY target IS NOT NULL")
def win_lead_edges(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target")).where("target is not null")


@query("agg_process_summary", "SELECT l_orderkey, count(*) AS steps, list_sort(list(DISTINCT l_linenumber)) = range(1, max(l_linenumber) + 1) AS continuous FROM lineitem GROUP BY 1")
def agg_process_summary(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.array_sort(F.collect_set("l_linenumber")).alias("s"), F.max("l_linenumber").alias("m"))
    return g.select("l_orderkey", "steps", (F.col("s") == F.sequence(F.lit(1), F.col("m"))).alias("continuous"))


# ---- sets -----------------------------------------------------------------------


@query("set_union_dedup_evidence", "SELECT lower(name) AS name, source FROM (SELECT n_name AS name, 1 AS source FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT upper(n_name), 3 FROM nation) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY source) = 1")
def set_union_dedup_evidence(t):
    u = t.nation.select(F.lower("n_name").alias("name"), F.lit(1).alias("source")).union(t.region.select(F.lower("r_name"), F.lit(2))).union(t.nation.select(F.lower("n_name"), F.lit(3)))
    return u.groupBy("name").agg(F.min("source").alias("source"))


@query("set_partition_dedup", "SELECT s AS types, min(p_brand) AS brand, count(*) AS merged FROM (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS s FROM part GROUP BY 1) GROUP BY s")
def set_partition_dedup(t):
    sets = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("types"))
    return sets.groupBy("types").agg(F.min("p_brand").alias("brand"), F.count("*").alias("merged"))


@query("set_difference_entry", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def set_difference_entry(t):
    return t.part.select("p_partkey").join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct()


@query("set_intersect_ids", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect_ids(t):
    return t.customer.select("c_custkey").intersect(t.orders.select("o_custkey"))


@query("set_dedup_nodes_edges", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_dedup_nodes_edges(t):
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@query("set_move_member", "SELECT p_partkey AS node, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS part FROM part")
def set_move_member(t):
    m = _members(t).select("node", "part")
    return m.where("part <> 'Brand#11'").union(m.where("part = 'Brand#11'").select("node", F.lit("Brand#12")))


@query("set_merge_partitions", with_("calls") + ", member AS (SELECT p_partkey AS node, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'merged_Brand#11' ELSE p_brand END AS part, p_type AS func FROM part)" + f", {_QUALITY} SELECT *, {_MOD} AS modularity FROM quality")
def set_merge_partitions(t):
    m = _members(t).withColumn("part", F.when(F.col("part").isin("Brand#11", "Brand#12"), "merged_Brand#11").otherwise(F.col("part")))
    return partition_quality(_calls(t), m)


@query("set_split_partition", "SELECT p_partkey AS node, CASE WHEN p_brand = 'Brand#11' THEN p_brand || '_' || (p_size % 2) ELSE p_brand END AS part FROM part")
def set_split_partition(t):
    return t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_brand") == "Brand#11", F.concat("p_brand", F.lit("_"), (F.col("p_size") % 2).cast("string"))).otherwise(F.col("p_brand")).alias("part"))


@query("agg_search_comparison", "SELECT sum((a IS NOT NULL AND b IS NULL)::INT)::BIGINT AS only_a, sum((a IS NULL AND b IS NOT NULL)::INT)::BIGINT AS only_b, sum((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS both_n FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') x FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderstatus = 'O') y ON a = b")
def agg_search_comparison(t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a")).distinct()
    b = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full")
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return j.agg(n(F.col("b").isNull(), "only_a"), n(F.col("a").isNull(), "only_b"), n(F.col("a").isNotNull() & F.col("b").isNotNull(), "both_n"))
