"""Queries of text and path scalars, sinks read back, and small projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import finance as M
from graphloom.functions import text as X
from graphloom.lineage import cut, work_dir
from graphloom.plans.book import query
from graphloom.plans.money import _N, _R, _c
from graphloom.sources import bindings as B
from graphloom.sources import code, sinks
from graphloom.sources.bindings import with_

# ---- text --------------------------------------------------------------------


@query("f_normalize_text", "SELECT c_custkey, trim(coalesce(c_mktsegment, '')) AS t FROM customer")
def f_normalize_text(t):
    return t.customer.select("c_custkey", X.normalize_text(F.col("c_mktsegment")).alias("t"))


@query("f_camel_split", "SELECT p_partkey, regexp_replace('part' || p_brand, '([a-z])([A-Z])', '\\1 \\2', 'g') AS t FROM part")
def f_camel_split(t):
    return t.part.select("p_partkey", F.regexp_replace(F.concat(F.lit("part"), "p_brand"), "([a-z])([A-Z])", "$1 $2").alias("t"))


@query("f_capitalize", "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS t FROM part")
def f_capitalize(t):
    return t.part.select("p_partkey", X.capitalize(F.col("p_name")).alias("t"))


@query("f_truncate_word", "WITH x AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS s FROM part), y AS (SELECT *, left(s, 20) AS h, instr(reverse(left(s, 20)), ' ') AS b FROM x) SELECT p_partkey, CASE WHEN length(s) <= 20 THEN s WHEN b > 0 AND 21 - b > 16 THEN left(h, 20 - b) ELSE h END AS t FROM y")
def f_truncate_word(t):
    return t.part.select("p_partkey", X.truncate_word(F.concat_ws(" ", "p_name", "p_brand", "p_type"), 20).alias("t"))


@query("f_clean_code", "SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents")
def f_clean_code(t):
    lines = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"[ \t]+\n", "\n")
    return t.documents.select("doc_id", F.regexp_replace(lines, r"\n{3,}", "\n\n").alias("t"))


@query("f_basename", "SELECT page_id, regexp_extract(url, '[^/]*$') AS t FROM pages")
def f_basename(t):
    return t.pages.select("page_id", X.basename(F.col("url")).alias("t"))


@query("f_dirname", "SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS t FROM pages")
def f_dirname(t):
    return t.pages.select("page_id", X.dirname(F.col("url")).alias("t"))


@query("f_normalize_path", "SELECT page_id, replace(replace(url, '/', chr(92)), chr(92), '/') AS t FROM pages")
def f_normalize_path(t):
    windows = F.replace("url", F.lit("/"), F.lit("\\"))
    return t.pages.select("page_id", F.replace(windows, F.lit("\\"), F.lit("/")).alias("t"))


@query("f_prefix", "SELECT regexp_extract(p_name, '^[a-z]+') AS prefix, count(*) AS n FROM part GROUP BY 1")
def f_prefix(t):
    return t.part.groupBy(F.regexp_extract("p_name", "^[a-z]+", 0).alias("prefix")).agg(F.count("*").alias("n"))


@query("f_suffix", "SELECT regexp_extract(p_name, '[a-z]+$') AS suffix, count(*) AS n FROM part GROUP BY 1")
def f_suffix(t):
    return t.part.groupBy(F.regexp_extract("p_name", "[a-z]+$", 0).alias("suffix")).agg(F.count("*").alias("n"))


@query("f_naming_style", "WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN replace(p_brand, '#', '') ELSE 'part' || replace(p_brand, '#', '') END AS s FROM part) SELECT p_partkey, CASE WHEN regexp_matches(s, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(s, '^[A-Z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(s, '^[a-z]+[A-Z][A-Za-z0-9]*$') THEN 'camel' WHEN regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' ELSE 'other' END AS style FROM x")
def f_naming_style(t):
    brand, kind = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey") % 4
    name = F.when(kind == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(kind == 2, brand).otherwise(F.concat(F.lit("part"), brand))
    return t.part.select("p_partkey", X.naming_style(name).alias("style"))


@query("f_string_jaccard", "WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '\\s+') AS w FROM conversations WHERE text IS NOT NULL) SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def f_string_jaccard(t):
    w = t.conversations.where("text is not null").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("w"))
    before = w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("b"))
    return w.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("b")), 6).alias("similarity"))


@query("f_currency_format", "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS t FROM orders")
def f_currency_format(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("t"))


@query("f_qa_format", "SELECT q.conv_id, q.turn, '问题: ' || q.text || chr(10) || '答案: ' || a.text AS t FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
def f_qa_format(t):
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("问题: "), "q", F.lit("\n答案: "), "a").alias("t"))


@query("f_html_md_headings", "SELECT page_id, array_to_string(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)<', 1), '|') AS headings FROM pages")
def f_html_md_headings(t):
    return t.pages.select("page_id", F.concat_ws("|", F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)<"), F.lit(1))).alias("headings"))


# ---- finance -----------------------------------------------------------------


@query("m_annualized", f"SELECT c_custkey, round(pow(1 + {_R}, 1.0::DOUBLE / {_N}) - 1, 6) AS rate FROM customer")
def m_annualized(t):
    return _c(t).select("c_custkey", F.round(M.annualized(F.col("r"), F.col("n")), 6).alias("rate"))


@query("m_compound", f"SELECT c_custkey, round(c_acctbal * pow(1 + {_R} / 12, 12 * {_N}), 4) AS value FROM customer")
def m_compound(t):
    return _c(t).select("c_custkey", F.round(M.future_value(F.col("a"), F.col("r") / 12, 12 * F.col("n")), 4).alias("value"))


@query("m_rule72", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'infinity'::DOUBLE ELSE 72.0::DOUBLE / (c_custkey % 10) END AS years FROM customer")
def m_rule72(t):
    return t.customer.select("c_custkey", M.rule_72(F.col("c_custkey") % 10).alias("years"))


# ---- sinks, read back ----------------------------------------------------------


def _place(t, name: str) -> str:
    return f"{work_dir(t.spark)}/graphloom-sinks/{name}-{uuid.uuid4().hex}"


@query("sink_csv_rfc4180", "SELECT p_partkey, p_name, p_brand FROM part")
def sink_csv_rfc4180(t):
    rows, path = t.part.select("p_partkey", "p_name", "p_brand"), _place(t, "csv")
    sinks.quoted_csv(rows, path)
    return code.csv_table(t.spark, path, "p_partkey long, p_name string, p_brand string")


@query("scan_csv_copy", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_csv_copy(t):
    path = _place(t, "copy")
    sinks.quoted_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return code.csv_table(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("sink_keyed_json", "SELECT event_id, event_type, value FROM events")
def sink_keyed_json(t):
    path = _place(t, "json")
    sinks.keyed_json(t.events.select("event_id", "event_type", "value"), "event_type", path)
    return t.spark.read.schema("event_id long, event_type string, value double").json(path)


@query("sink_atomic", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_atomic(t):
    return cut(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "atomic")


@query("sink_graph_json", with_("calls") + "SELECT '{\"data\":{\"id\":' || p_partkey || ',\"label\":\"' || p_brand || '\"}}' AS element FROM part UNION ALL SELECT '{\"data\":{\"caller\":' || caller || ',\"callee\":' || callee || '}}' FROM calls")
def sink_graph_json(t):
    return sinks.graph_json(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label")), B.calls(t.lineitem))


@query("sink_summary_json", with_("calls") + "SELECT '{\"edges\":' || count(*) || ',\"callers\":' || count(DISTINCT caller) || ',\"callees\":' || count(DISTINCT callee) || '}' AS summary FROM calls")
def sink_summary_json(t):
    # Distinct ends are counted after a grouping of each side, so no row is multiplied.
    calls = B.calls(t.lineitem)
    sides = calls.groupBy("caller").agg(F.count("*").alias("n")).agg(F.sum("n").alias("edges"), F.count("*").alias("callers"))
    ends = calls.select("callee").distinct().agg(F.count("*").alias("callees"))
    return sides.join(F.broadcast(ends)).select(F.to_json(F.struct(F.coalesce("edges", F.lit(0)).alias("edges"), "callers", "callees")).alias("summary"))


@query("sink_mermaid", with_("calls") + "SELECT '  n' || caller || ' --> n' || callee AS line FROM calls")
def sink_mermaid(t):
    return B.calls(t.lineitem).select(F.format_string("  n%d --> n%d", "caller", "callee").alias("line"))


# ---- projections -----------------------------------------------------------------


@query("q_file_graph", with_("calls", "location") + "SELECT a.file AS source, b.file AS target, count(*) AS weight FROM calls JOIN location a ON caller = a.node JOIN location b ON callee = b.node WHERE a.file <> b.file GROUP BY 1, 2")
def q_file_graph(t):
    at = B.location(t.lineitem)
    both = B.calls(t.lineitem).join(at.toDF("caller", "source"), "caller").join(at.toDF("callee", "target"), "callee")
    return both.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


@query("q_type_hierarchy", with_("extends") + "SELECT child, parent, 'inherits' AS kind FROM extends UNION ALL SELECT r_name, NULL, 'root' FROM region")
def q_type_hierarchy(t):
    edges = B.extends(t.region, t.nation, t.customer).select("child", "parent", F.lit("inherits").alias("kind"))
    return edges.union(t.region.select("r_name", F.lit(None).cast("string"), F.lit("root")))


@query("q_source_snippet", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents WHERE text IS NOT NULL")
def q_source_snippet(t):
    return t.documents.where("text is not null").select("doc_id", F.concat_ws("\n", F.slice(F.split("text", "\n"), 2, 3)).alias("snippet"))


@query("q_best_payload", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) = 1")
def q_best_payload(t):
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.coalesce("n_chars", F.lit(-1)), -F.col("doc_id"))).alias("b")
    return t.documents.groupBy("source").agg(best).select("source", "b.doc_id", "b.n_chars")


@query("q_project_profiles", "SELECT p_brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS profile, count(*) AS n FROM part GROUP BY 1")
def q_project_profiles(t):
    return t.part.groupBy("p_brand").agg(F.concat_ws(" ", F.array_sort(F.collect_set("p_type"))).alias("profile"), F.count("*").alias("n"))


@query("q_config_transform", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name) ELSE trim(c_name) END AS value FROM customer")
def q_config_transform(t):
    kind = F.col("c_custkey") % 3
    return t.customer.select("c_custkey", F.when(kind == 0, F.upper("c_name")).when(kind == 1, F.lower("c_name")).otherwise(F.trim("c_name")).alias("value"))


@query("q_symbol_index", with_("location") + "SELECT p_name AS name, min(file) AS file, count(DISTINCT file) AS places FROM part JOIN location ON node = p_partkey GROUP BY 1")
def q_symbol_index(t):
    named = t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")).join(B.location(t.lineitem), "node")
    return named.groupBy("name").agg(F.min("file").alias("file"), F.count_distinct("file").alias("places"))


@query("q_followup_select", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def q_followup_select(t):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")
