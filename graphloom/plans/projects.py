"""Queries over files and code: scans, symbols, control and data flow, text functions, and the views made of them.

Code files stand for parts: one module each, with a class, a method and a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import text as X
from graphloom.lineage import cut
from graphloom.plans.book import Tables, query
from graphloom.sources import bindings as B
from graphloom.sources import code, flow, workbook
from graphloom.sources.bindings import with_

CODE = with_("sources")
CALLS = with_("calls")
_lines = lambda c: f"unnest(string_split({c}, chr(10)))"


def _sources(t: Tables) -> DataFrame:
    return B.sources(t.part)


# ---- scans ------------------------------------------------------------------

def _walk(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    ignored = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, code.IGNORED)))
    return files.where(ext.isin(*extensions) & ~ignored).select("path", ext.alias("extension"))


_WALK = CODE + rf"SELECT path, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS extension FROM sources WHERE extension IN {{e}} AND len(list_intersect(string_split(path, '/'), {list(code.IGNORED)})) = 0"


@query("scan_code_walk", _WALK.format(e=code.CODE))
def scan_code_walk(t):
    return _walk(_sources(t), code.CODE)


@query("scan_py_files", _WALK.format(e="('py')"))
def scan_py_files(t):
    return _walk(_sources(t), ("py",))


@query("scan_bounded_text", "SELECT doc_id, substr(coalesce(text, ''), 1, 2000) AS head, length(coalesce(text, '')) > 2000 AS cut FROM documents")
def scan_bounded_text(t):
    whole = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.substring(whole, 1, 2000).alias("head"), (F.length(whole) > 2000).alias("cut"))


_FUZZY = "WITH asked AS (SELECT page_id AS ask, regexp_extract(regexp_replace(url, '[?].*', ''), '([^/]+/[^/]+)$', 1) AS want FROM pages WHERE page_id % 20 = 0), files AS (SELECT page_id, regexp_replace(url, '[?].*', '') AS path FROM pages)"


@query(
    "scan_read_fuzzy",
    _FUZZY + ", scored AS (SELECT ask, page_id, CASE WHEN path = want THEN 1000 WHEN path LIKE '%/' || want THEN 100 + greatest(0, 200 - length(path)) ELSE 10 END AS score FROM asked JOIN files ON string_split(path, '/')[-1] = string_split(want, '/')[-1])"
    " SELECT ask, page_id, score::BIGINT AS score FROM scored WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, page_id) = 1",
)
def scan_read_fuzzy(t):
    """The file that a partly written path means: the path itself, one that ends with it, or one with its last segment."""
    path = F.regexp_replace("url", "[?].*", "")
    asked = t.pages.where("page_id % 20 = 0").select(F.col("page_id").alias("ask"), F.regexp_extract(path, "([^/]+/[^/]+)$", 1).alias("want"))
    files = t.pages.select("page_id", path.alias("path"), X.basename(path).alias("last"))
    x = asked.join(files, X.basename(F.col("want")) == F.col("last"))
    score = F.when(F.col("path") == F.col("want"), 1000).when(F.endswith("path", F.concat(F.lit("/"), "want")), 100 + F.greatest(F.lit(0), 200 - F.length("path"))).otherwise(10)
    rank = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "page_id"))
    return x.select("ask", "page_id", score.cast("long").alias("score")).withColumn("rank", rank).where("rank = 1").drop("rank")


@query("scan_json_graph", "SELECT event_id, printf('%s %d: k is %d', event_type, event_id, (props->>'$.k')::BIGINT) AS chunk FROM events")
def scan_json_graph(t):
    """Text chunks by type from JSON nodes."""
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", F.format_string("%s %d: k is %d", "event_type", "event_id", k).alias("chunk"))


@query("scan_json_paths", "SELECT o_custkey AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS layer, o_orderkey AS node FROM orders")
def scan_json_paths(t):
    """Layered nodes of the paths in one JSON document a partition."""
    docs = t.orders.groupBy(F.col("o_custkey").alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: F.struct(s["o_orderkey"].alias("node")))).alias("doc"))
    return docs.select("part", F.posexplode(F.from_json("doc", "array<struct<node: long>>")).alias("layer", "x")).select("part", F.col("layer").cast("long").alias("layer"), "x.node")


@query("scan_keyed_json", "SELECT user_id, count(*) AS n, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS latest, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY user_id")
def scan_keyed_json(t):
    """Documents of every key, the last updated first; there is a row for each key."""
    keys = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("updated_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))
    later = keys.select("updated_at", "user_id").repartitionByRange(F.desc("updated_at"), F.asc("user_id")).sortWithinPartitions(F.desc("updated_at"), "user_id").withColumn("part", F.spark_partition_id())
    later = cut(later.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(F.desc("updated_at"), "user_id"))), "places")
    before = later.groupBy("part").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    places = later.join(F.broadcast(before), "part").select("user_id", (F.col("own") + F.col("before")).cast("long").alias("place"))
    return keys.join(places, "user_id")


@query("scan_zip_git", CODE + "SELECT path, length(content) AS size FROM sources")
def scan_zip_git(t):
    """Files of zip archives, one archive a folder of sources."""
    return code.unzipped(code.zipped(_sources(t), X.dirname(F.col("path")))).select("path", F.length("content").cast("long").alias("size"))


@query("scan_xlsx_qa", "WITH q AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS row_id FROM q) SELECT conv_id AS source, row_id, question, coalesce(answer, '') AS answer FROM r WHERE coalesce(question, '') <> '' OR coalesce(answer, '') <> ''")
def scan_xlsx_qa(t):
    """Question and answer rows read back from workbooks, one a conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"))
    books = workbook.written(rows, "conv_id", "turn", ["question", "answer"])
    return workbook.questions(books).select(F.col("source").cast("long").alias("source"), "row_id", "question", "answer")


@query("scan_comments", CODE + rf"SELECT path, line - 1 AS line, trim(regexp_extract(text, '#(.*)$', 1)) AS comment FROM (SELECT path, {_lines('content')} AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM sources) WHERE contains(text, '#')")
def scan_comments(t):
    x = _sources(t).select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).where(F.contains("text", F.lit("#")))
    return x.select("path", F.col("line").cast("long").alias("line"), F.trim(F.regexp_extract("text", "#(.*)$", 1)).alias("comment"))


_SYMBOLS = """SELECT path, 'import' AS kind, '' AS owner, unnest(['os', 'lib.helper']) AS name FROM sources UNION ALL SELECT path, 'class', '', 'C' || key FROM sources
UNION ALL SELECT path, 'method', 'C' || key, 'm' || key FROM sources UNION ALL SELECT path, 'call', 'C' || key || '.m' || key, 'helper' FROM sources"""


@query("scan_ast_symbols", CODE + _SYMBOLS)
def scan_ast_symbols(t):
    return code.python_symbols(_sources(t)).select("path", "kind", "owner", "name")


@query("scan_treesitter", CODE + r"SELECT path, lower(kind) AS kind, name, name NOT LIKE '\_%' ESCAPE '\' AS exported FROM (SELECT path, regexp_extract(text, '^\s*(class|def)\s+(\w+)', 1) AS kind, regexp_extract(text, '^\s*(class|def)\s+(\w+)', 2) AS name FROM (SELECT path, unnest(string_split(content, chr(10))) AS text FROM sources)) WHERE kind <> ''")
def scan_treesitter(t):
    """Definitions by pattern, whatever the language's grammar, and whether they are exported."""
    x = _sources(t).select("path", F.explode(F.split("content", "\n")).alias("text"))
    found = lambda k: F.regexp_extract("text", r"^\s*(class|def)\s+(\w+)", k)
    return x.select("path", found(1).alias("kind"), found(2).alias("name")).where("kind <> ''").withColumn("exported", ~F.startswith("name", F.lit("_")))


# ---- symbols and flow ---------------------------------------------------------


@query("q_entry_main_scan", CODE + "SELECT string_split(path, '/')[2] AS folder, count(*) AS files, sum((contains(content, '__main__') OR regexp_matches(content, 'def main\\b'))::INT)::BIGINT AS mains FROM sources GROUP BY 1")
def q_entry_main_scan(t):
    main = F.contains("content", F.lit("__main__")) | F.col("content").rlike(r"def main\b")
    return _sources(t).groupBy(F.split("path", "/")[1].alias("folder")).agg(F.count("*").alias("files"), F.sum(main.cast("int")).alias("mains"))


@query("q_field_access", CODE + "SELECT path, 'C' || key || '.m' || key AS method, unnest(['size', 'brand']) AS field, unnest(['write', 'read']) AS access FROM sources")
def q_field_access(t):
    return flow.statements(_sources(t)).where("kind in ('write', 'read')").select("path", "method", F.col("name").alias("field"), F.col("kind").alias("access")).distinct()


@query("q_var_deps", CODE + "SELECT path, 'C' || key || '.m' || key AS method, unnest(['self.size', 'y', 'y', 'y']) AS variable, unnest(['x', 'helper', 'self', 'self.brand']) AS needs FROM sources")
def q_var_deps(t):
    return flow.statements(_sources(t)).where("kind = 'needs'").select("path", "method", F.col("name").alias("variable"), F.col("other").alias("needs")).distinct()


@query("q_def_use", CODE + "SELECT path, 'C' || key || '.m' || key AS method, ['y'] AS defs, ['helper', 'self', 'y'] AS uses FROM sources")
def q_def_use(t):
    """Local names that a method sets, and all but its parameters that it uses."""
    x = flow.statements(_sources(t))
    one = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return x.groupBy("path", "method").agg(one("def").alias("defs"), one("use").alias("uses"), one("param").alias("params")).select("path", "method", F.array_except("defs", "params").alias("defs"), F.array_sort(F.array_except("uses", F.array_except("params", F.array(F.lit("self"))))).alias("uses"))


_CFG = "SELECT path, 'C' || key || '.m' || key AS method, unnest([10, 11, 12, 11]) AS line, unnest([11, 12, 13, 13]) AS next, unnest(['next', 'true', 'next', 'false']) AS kind FROM sources"


@query("g_cfg", CODE + _CFG)
def g_cfg(t):
    """Control flow: edges between the lines of statements."""
    return flow.control(_sources(t))


_DFG = "SELECT path, 'C' || key || '.m' || key AS method, unnest(['x', 'x', 'y']) AS name, unnest([8, 8, 12]) AS line, unnest([10, 11, 13]) AS used FROM sources"


@query("g_dfg", CODE + _DFG)
def g_dfg(t):
    """Data flow: from the line that last set a name to those that use it."""
    return flow.data(_sources(t))


@query("g_io", CODE + "SELECT path, 'C' || key || '.m' || key AS method, ['self', 'x'] AS inputs, ['return', 'self.size'] AS outputs FROM sources")
def g_io(t):
    x = flow.statements(_sources(t))
    one = lambda kind, name: F.array_sort(F.collect_set(F.when(kind, name)))
    out = one(F.col("kind").isin("write", "return"), F.when(F.col("kind") == "write", F.concat(F.lit("self."), "name")).otherwise("return"))
    return x.groupBy("path", "method").agg(one(F.col("kind") == "param", F.col("name")).alias("inputs"), out.alias("outputs"))


def _along(edges: DataFrame, t: Tables) -> DataFrame:
    """Flow edges with method ids, and the edges of calls between the methods' modules."""
    own = edges.select(F.regexp_extract("path", r"m(\d+)\.py$", 1).cast("long").alias("module"), "line", "target", F.lit("inner").alias("kind"))
    calls = B.calls(t.lineitem).select(F.col("caller").alias("module"), F.lit(12).cast("long").alias("line"), F.col("callee").alias("target"), F.lit("call").alias("kind"))
    return own.unionByName(calls)


@query("g_partition_cfg", with_("sources", "calls") + f"SELECT key AS module, line::BIGINT AS line, next::BIGINT AS target, 'inner' AS kind FROM ({_CFG.replace('FROM sources', '')}, key FROM sources) UNION ALL SELECT caller, 12, callee, 'call' FROM calls ")
def g_partition_cfg(t):
    """The control flow of all methods, joined by the calls between them."""
    return _along(flow.control(_sources(t)).withColumnRenamed("next", "target"), t)


@query("g_partition_dfg", with_("sources", "calls") + f"SELECT key AS module, line::BIGINT AS line, used::BIGINT AS target, 'inner' AS kind FROM ({_DFG.replace('FROM sources', '')}, key FROM sources) UNION ALL SELECT caller, 12, callee, 'call' FROM calls ")
def g_partition_dfg(t):
    return _along(flow.data(_sources(t)).withColumnRenamed("used", "target"), t)


_STITCH = "WITH step AS (SELECT o_custkey AS part, o_orderkey AS module, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) SELECT part, module, unnest([1, 2]) AS line, unnest([2, 3]) AS target, 'inner' AS kind FROM step UNION ALL SELECT part, module, 3, 1, 'boundary' FROM step WHERE next IS NOT NULL"


@query("g_path_level_cfg", _STITCH)
def g_path_level_cfg(t):
    """The three lines of every method of a path, one after the other, and the edges from a method to the next of its path."""
    step = t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("module"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"))
    inner = step.select("part", "module", F.explode(F.array(F.lit(1), F.lit(2))).alias("line")).select("part", "module", "line", (F.col("line") + 1).alias("target"), F.lit("inner").alias("kind"))
    return inner.unionByName(step.where("next is not null").select("part", "module", F.lit(3).alias("line"), F.lit(1).alias("target"), F.lit("boundary").alias("kind")))


@query("q_dataflow_graph", CODE + "SELECT DISTINCT 'C' || key AS owner, unnest(['size', 'brand', 'y']) AS node, unnest(['field', 'field', 'variable']) AS kind FROM sources")
def q_dataflow_graph(t):
    x = flow.statements(_sources(t))
    owner = F.split("method", r"\.")[0].alias("owner")
    fields = x.where("kind in ('write', 'read')").select(owner, F.col("name").alias("node"), F.lit("field").alias("kind"))
    return fields.union(x.where("kind = 'def'").select(owner, "name", F.lit("variable"))).distinct()


@query("join_resolve_method_py", CODE + "SELECT path, 'C' || key || '.m' || key AS caller, 'helper' AS callee, 'import' AS how FROM sources")
def join_resolve_method_py(t):
    """Calls by how they are written: through self, through a name that the file imports, or bare."""
    s = code.python_symbols(_sources(t)).select("path", "kind", "owner", "name")
    imports = s.where("kind = 'import'").select("path", F.element_at(F.split("name", r"\."), -1).alias("name"), F.lit(True).alias("known"))
    calls = s.where("kind = 'call'").select("path", F.col("owner").alias("caller"), "name")
    how = F.when(F.startswith("name", F.lit("self.")), "self").when(F.col("known"), "import").when(F.contains("name", F.lit(".")), "object").otherwise("bare")
    return calls.join(imports, ["path", "name"], "left").select("path", "caller", F.element_at(F.split("name", r"\."), -1).alias("callee"), how.alias("how"))


@query("q_comment_rollup", CODE + "SELECT 'C' || key AS owner, 1::BIGINT AS comments, p_name || ' of ' || p_type || '.' AS docstring FROM sources")
def q_comment_rollup(t):
    s = code.python_symbols(_sources(t)).where("kind = 'class'").select("path", F.col("name").alias("owner"), "docstring")
    n = scan_comments(t).groupBy("path").agg(F.count("*").alias("comments"))
    return s.join(n, "path", "left").select("owner", F.coalesce("comments", F.lit(0)).alias("comments"), "docstring")


_CLUES = CODE + "SELECT path, 2::BIGINT AS imports, 0::BIGINT AS decorators, 0::BIGINT AS exceptions, 'Base' || size % 5 AS base FROM sources"


@query("q_semantic_clues", _CLUES)
def q_semantic_clues(t):
    n = lambda p: F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0))).cast("long")
    return _sources(t).select("path", n(r"(?m)^(import|from) ").alias("imports"), n(r"(?m)^\s*@\w+").alias("decorators"), n(r"\b(raise|except)\b").alias("exceptions"), F.regexp_extract("content", r"class \w+\((\w+)\)", 1).alias("base"))


@query("q_method_profile", with_("sources", "location") + "SELECT 'm' || s.key AS method, p_name || ' of ' || p_type || '.' AS docstring, file AS defined_in, 'Base' || size % 5 AS base FROM sources s LEFT JOIN location l ON l.node = s.key")
def q_method_profile(t):
    """Methods with what documents them, where they are defined and what their class extends."""
    s = code.python_symbols(_sources(t))
    doc = s.where("kind = 'class'").select("path", "docstring", F.col("details")[0].alias("base"))
    where = B.location(t.lineitem).select(F.col("node").alias("key"), F.col("file").alias("defined_in"))
    m = s.where("kind = 'method'").select("path", F.col("name").alias("method"), F.substr("name", F.lit(2)).cast("long").alias("key"))
    return m.join(doc, "path").join(where, "key", "left").select("method", "docstring", "defined_in", "base")


@query("q_ts_imports", CODE + "SELECT path, unnest(['os', 'lib']) AS imported FROM sources")
def q_ts_imports(t):
    x = _sources(t).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:import|from)\s+([\w.]+)"), F.lit(1))).alias("imported"))
    return x.distinct()


@query("q_code_refs", CODE + "SELECT 'C' || key AS class, 'm' || key AS method, path, 8::BIGINT AS line, '    def m' || key || '(self, x):' AS snippet FROM sources")
def q_code_refs(t):
    m = code.python_symbols(_sources(t)).where("kind = 'method'").select("path", F.col("owner").alias("class"), F.col("name").alias("method"), "line")
    return m.join(_sources(t).select("path", "content"), "path").select("class", "method", "path", "line", F.element_at(F.split("content", "\n"), F.col("line").cast("int")).alias("snippet"))


@query("q_file_tree", CODE + ", d AS (SELECT string_split(path, '/') AS s FROM sources), n AS (SELECT array_to_string(s[1:i], '/') AS node, i, i = len(s) AS leaf FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM d)) SELECT node, min(i) - 1 AS depth, bool_and(leaf) AS file, count(*) AS files FROM n GROUP BY node")
def q_file_tree(t):
    s = F.split("path", "/")
    x = _sources(t).select(s.alias("s"), F.explode(F.sequence(F.lit(1), F.size(s))).alias("i"))
    x = x.select(F.concat_ws("/", F.slice("s", 1, F.col("i"))).alias("node"), "i", (F.col("i") == F.size("s")).alias("leaf"))
    return x.groupBy("node").agg((F.min("i") - 1).cast("long").alias("depth"), F.bool_and("leaf").alias("file"), F.count("*").alias("files"))


# ---- text functions -------------------------------------------------------------


@query("f_sanitize_id", "SELECT p_partkey, lower(substr(regexp_replace(p_name || '.' || p_type, '[^A-Za-z0-9]', '_', 'g'), 1, 20)) AS id FROM part")
def f_sanitize_id(t):
    return t.part.select("p_partkey", F.lower(F.substring(F.regexp_replace(F.concat_ws(".", "p_name", "p_type"), "[^A-Za-z0-9]", "_"), 1, 20)).alias("id"))


_PATH_TOKENS = r"list_filter(string_split(lower(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z]+', ' ', 'g')), ' '), lambda w: w <> '')"


def path_tokens(path: Column) -> Column:
    """Lower-case words of a path, camel case parted."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(path, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+", " ")), " "), lambda w: w != "")


@query("f_path_tokens", f"SELECT page_id, {_PATH_TOKENS.format(x='url')} AS tokens FROM pages")
def f_path_tokens(t):
    return t.pages.select("page_id", path_tokens(F.col("url")).alias("tokens"))


#: Domains by their keywords, the first that fits (fixed values).
DOMAINS = (("hardware", "bolt|gear|ring"), ("apparatus", "widget|valve|panel"), ("general", "."))


def _first(value: Column, rules: tuple) -> Column:
    out = F.lit(None)
    for label, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), label).otherwise(out)
    return out


_domain = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{d}'" for d, p in DOMAINS) + " END"


@query("f_domain", f"SELECT p_partkey, {_domain('p_name')} AS domain FROM part")
def f_domain(t):
    return t.part.select("p_partkey", _first(F.col("p_name"), DOMAINS).alias("domain"))


@query("f_semantic_label", f"SELECT p_partkey, {_domain('p_name')} || ': ' || string_split(p_name, ' ')[-1] || ' (' || lower(p_type) || ')' AS label FROM part")
def f_semantic_label(t):
    return t.part.select("p_partkey", F.concat(_first(F.col("p_name"), DOMAINS), F.lit(": "), F.element_at(F.split("p_name", " "), -1), F.lit(" ("), F.lower("p_type"), F.lit(")")).alias("label"))


@query("f_path_desc", "SELECT l_orderkey, printf('%d steps from %d to %d', count(*), arg_min(l_partkey, (l_linenumber, l_partkey)), arg_max(l_partkey, (l_linenumber, l_partkey))) AS text FROM lineitem GROUP BY 1")
def f_path_desc(t):
    at = F.struct("l_linenumber", "l_partkey")
    return t.lineitem.groupBy("l_orderkey").agg(F.format_string("%d steps from %d to %d", F.count("*"), F.min_by("l_partkey", at), F.max_by("l_partkey", at)).alias("text"))


_PURPOSE = "CASE WHEN coalesce(doc, '') <> '' THEN string_split(doc, '.')[1] WHEN verb IN ('get', 'load', 'read') THEN 'Reads ' || rest WHEN verb IN ('set', 'save', 'write') THEN 'Writes ' || rest ELSE 'Handles ' || rest END"


@query("f_purpose", f"SELECT p_partkey, {_PURPOSE} AS purpose FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || '. More.' END AS doc, ['get', 'save', 'run'][p_partkey % 3 + 1] AS verb, p_name AS rest FROM part)")
def f_purpose(t):
    """The head of a docstring, or else what the verb of a name says."""
    verb = F.element_at(F.array(F.lit("get"), F.lit("save"), F.lit("run")), (F.col("p_partkey") % 3 + 1).cast("int"))
    doc = F.when(F.col("p_size") > 25, F.concat("p_type", F.lit(". More.")))
    said = F.when(verb.isin("get", "load", "read"), F.lit("Reads ")).when(verb.isin("set", "save", "write"), F.lit("Writes ")).otherwise(F.lit("Handles "))
    return t.part.select("p_partkey", F.when(F.coalesce(doc, F.lit("")) != "", F.split(doc, r"\.")[0]).otherwise(F.concat(said, "p_name")).alias("purpose"))


@query("f_verb_description", "SELECT user_id, string_agg(event_type, ' then ' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id")
def f_verb_description(t):
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t.events.groupBy("user_id").agg(F.concat_ws(" then ", F.transform(steps, lambda s: s["event_type"])).alias("text"))


@query("f_chunk_text", "SELECT doc_id, i AS chunk, substr(text, (i * 700 + 1)::BIGINT, 800) AS part FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE greatest(1, ceil((length(text) - 100) / 700.0)::BIGINT) END)) AS i FROM documents WHERE text IS NOT NULL)")
def f_chunk_text(t):
    """Chunks of 800 characters that share 100 with the next; short texts stay whole."""
    n = F.when(F.length("text") <= 500, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 700.0))).cast("long")
    x = t.documents.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return x.select("doc_id", "chunk", F.expr("substr(text, cast(chunk * 700 + 1 as int), 800)").alias("part"))


_MD = "'# ' || p_name || chr(10) || 'about ' || p_type || chr(10) || '## Size' || chr(10) || p_size"


@query("f_md_sections", "SELECT p_partkey, unnest([1, 2]) AS level, unnest([p_name, 'Size']) AS heading, unnest(['about ' || p_type, p_size::VARCHAR]) AS body FROM part")
def f_md_sections(t):
    md = F.concat(F.lit("# "), "p_name", F.lit("\nabout "), "p_type", F.lit("\n## Size\n"), F.col("p_size").cast("string"))
    s = t.part.select("p_partkey", F.explode(F.filter(F.split(md, r"(?m)^(?=#+ )"), lambda x: x != "")).alias("s"))
    return s.select("p_partkey", F.length(F.regexp_extract("s", "^(#+) ", 1)).alias("level"), F.regexp_extract("s", r"^#+ ([^\n]*)", 1).alias("heading"), F.trim(F.regexp_replace("s", r"^#+ [^\n]*\n?|\n$", "")).alias("body"))
