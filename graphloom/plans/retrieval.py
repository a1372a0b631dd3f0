"""Queries of search, ranking and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.lineage import cut
from graphloom.operators import search as S
from graphloom.operators import vectors as V
from graphloom.plans.book import Tables, query

_TOK = "list_filter(regexp_extract_all(lower({t}), '[a-z][a-z0-9]*'), lambda w: length(w) > 1)"
_RUNS = r"'[\p{L}\p{N}_]+'"
_DEFAULT = rf"list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace({{t}}, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-/]', ' ', 'g')), {_RUNS.replace('{', '{{').replace('}', '}}')}), lambda w: regexp_full_match(w, '[a-z][a-z0-9]+') AND w NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)}))"
_SEMANTIC = rf"list_filter(regexp_extract_all(regexp_replace(lower(trim({{t}})), '[_\-/\\.]', ' ', 'g'), {_RUNS.replace('{', '{{').replace('}', '}}')}), lambda w: regexp_full_match(w, '[a-z0-9]{{{{2,}}}}'))"
_TERMS = f"WITH docs AS (SELECT doc_id AS id, {_DEFAULT.format(t='text')} AS w, {_SEMANTIC.format(t='text')} AS sw, lower(text) AS low FROM documents), terms AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM docs) GROUP BY ALL), asked AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({_DEFAULT.format(t='text')}) AS term FROM benchmark) GROUP BY ALL)"
_BM25 = """, size AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM docs),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term), idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, size),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
bm AS (SELECT query, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM terms JOIN asked USING (term) JOIN idf USING (term), size GROUP BY query, id HAVING score > 0),
bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM bm)"""
_JAC = f""", sets AS (SELECT id, list_distinct(sw) AS s, low FROM docs), questions AS (SELECT item_id AS query, lower(trim(text)) AS q, list_distinct({_SEMANTIC.format(t='text')}) AS t FROM benchmark), qt AS (SELECT query, unnest(t) AS term FROM questions),
both_n AS (SELECT query, id, n, count(*) AS k FROM (SELECT id, len(s) AS n, unnest(s) AS term FROM sets) JOIN qt USING (term) GROUP BY ALL),
jac AS (SELECT query, id, round(least(k / (n + len(t) - k) + CASE WHEN contains(low, q) THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS score FROM both_n JOIN questions USING (query) JOIN sets USING (id)), jac_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM jac)"""
_RRF = ", fused AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 8)::DOUBLE AS score, count(*) AS sources FROM (SELECT query, id, rank FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query, id, rank FROM jac_ranked WHERE rank <= 20) GROUP BY ALL), hybrid AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fused)"


def _asked(t: Tables) -> DataFrame:
    """(query, term, qf): the terms of every question, and how often it has them."""
    return t.benchmark.select(F.col("item_id").alias("query"), F.explode(X.default_tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))


def _questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query"), "text")


def _terms(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    return cut(S.term_lists(t.documents if docs is None else docs, "doc_id", "text"), "terms")


@query("s_bm25", _TERMS + _BM25 + " SELECT query, id, score, rank FROM bm_ranked WHERE rank <= 10")
def s_bm25(t):
    return S.bm25(_terms(t), _asked(t), 10, t.documents.count())


@query("topk_bm25", _TERMS + _BM25 + " SELECT query, id, score, rank FROM bm_ranked WHERE rank <= 3")
def topk_bm25(t):
    return S.bm25(_terms(t), _asked(t), 3, t.documents.count())


@query("s_jaccard_semantic", _TERMS + _JAC + " SELECT query, id, score, rank FROM jac_ranked WHERE rank <= 10")
def s_jaccard_semantic(t):
    return S.overlap(t.documents, "doc_id", "text", _questions(t), 10)


def _hybrid(t: Tables, top: int, docs: DataFrame | None = None) -> DataFrame:
    """Of the documents, or of ``docs``, the same ones dealt out in another way."""
    docs = t.documents if docs is None else docs
    return S.fused([S.bm25(_terms(t, docs), _asked(t), 20, docs.count()), S.overlap(docs, "doc_id", "text", _questions(t), 20)], top)


@query("s_rrf", _TERMS + _BM25 + _JAC + _RRF + " SELECT query, id, score, sources, rank FROM hybrid WHERE rank <= 40")
def s_rrf(t):
    return _hybrid(t, 40)


@query("s_hybrid", _TERMS + _BM25 + _JAC + _RRF + " SELECT query, id, score, sources, rank FROM hybrid WHERE rank <= 10")
def s_hybrid(t):
    return _hybrid(t, 10)


_CTX = " SELECT h.query, h.id, h.score, h.rank, d.source AS community, coalesce(n.docs, 0) AS neighbours, CASE WHEN h.sources = 2 THEN 'both' ELSE 'single' END AS found FROM hybrid h JOIN documents d ON h.id = d.doc_id LEFT JOIN (SELECT source, lang, count(*) AS docs FROM documents GROUP BY ALL) n ON n.source = d.source AND n.lang = d.lang WHERE h.rank <= 10"


@query("s_hybrid_graph", _TERMS + _BM25 + _JAC + _RRF + _CTX)
def s_hybrid_graph(t):
    """Hybrid search with each hit's community and the size of its neighbourhood in it."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("community"), "lang")
    near = t.documents.groupBy(F.col("source").alias("community"), "lang").agg(F.count("*").alias("neighbours"))
    h = _hybrid(t, 10).join(d, "id").join(near, ["community", "lang"], "left")
    return h.select("query", "id", "score", "rank", "community", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.when(F.col("sources") == 2, "both").otherwise("single").alias("found"))


@query("agg_group_by_process", _TERMS + _BM25 + " SELECT query, source, count(*) AS hits FROM bm_ranked JOIN documents ON id = doc_id WHERE rank <= 10 GROUP BY ALL")
def agg_group_by_process(t):
    h = S.bm25(_terms(t), _asked(t), 10, t.documents.count()).join(t.documents, F.col("id") == F.col("doc_id"))
    return h.groupBy("query", "source").agg(F.count("*").alias("hits"))


_RUN = "SELECT query, list(id ORDER BY rank) AS {} FROM hybrid WHERE rank <= 5 GROUP BY query"


@query(
    "agg_benchmark_summary",
    _TERMS + _BM25 + _JAC + _RRF + f", one AS ({_RUN.format('x')}), two AS ({_RUN.format('y')})"
    ", held AS (SELECT DISTINCT query FROM (SELECT query, unnest(x) AS id FROM one) JOIN documents d ON id = doc_id JOIN benchmark b ON query = item_id WHERE trim(b.text) <> '' AND contains(lower(d.text), lower(trim(b.text))))"
    ", runs AS (SELECT h.query IS NOT NULL AS hit, coalesce(x[1] = y[1], false) AS stable, CASE WHEN x IS NULL AND y IS NULL THEN 1.0 WHEN x IS NULL OR y IS NULL THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END::DOUBLE AS jaccard FROM benchmark LEFT JOIN one ON one.query = item_id LEFT JOIN two ON two.query = item_id LEFT JOIN held h ON h.query = item_id)"
    " SELECT count(*) AS queries, coalesce(round(avg(hit::INT), 6), 0)::DOUBLE AS hit_rate, coalesce(round(avg(stable::INT), 6), 0)::DOUBLE AS top1_stability, coalesce(round(avg(jaccard), 6), 0)::DOUBLE AS avg_jaccard FROM runs",
)
def agg_benchmark_summary(t):
    """Every item searched for twice, the second time over documents dealt out anew.

    The share of items with a document among the first five that holds their text,
    the share whose first document is the same both times, and the mean Jaccard of
    the first five; items that find nothing count too.
    """
    again = t.documents.repartition(max(2, t.documents.rdd.getNumPartitions()), "doc_id")
    one, two = (cut(_hybrid(t, 5, docs), "run") for docs in (t.documents, again))
    held = one.select("query", "id").join(t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low")), "id").join(_questions(t).withColumn("q", F.lower(F.trim("text"))), "query")
    held = held.where((F.col("q") != "") & F.contains("low", F.col("q"))).select("query").distinct().withColumn("hit", F.lit(1))
    lists = lambda run, c: run.groupBy("query").agg(F.collect_set("id").alias(c), F.min_by("id", "rank").alias(f"{c}1"))
    runs = _questions(t).join(lists(one, "x"), "query", "left").join(lists(two, "y"), "query", "left").join(held, "query", "left")
    jaccard = F.when(F.col("x").isNull() & F.col("y").isNull(), 1.0).when(F.col("x").isNull() | F.col("y").isNull(), 0.0).otherwise(X.jaccard(F.col("x"), F.col("y")))
    rate = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return runs.agg(F.count("*").alias("queries"), rate(F.coalesce("hit", F.lit(0))).alias("hit_rate"), rate(F.coalesce(F.col("x1") == F.col("y1"), F.lit(False)).cast("int")).alias("top1_stability"), rate(jaccard).alias("avg_jaccard"))


@query("s_topk_jaccard_eval", _TERMS + _BM25 + _JAC + ", a AS (SELECT query, arg_min(id, rank) AS x FROM bm_ranked GROUP BY 1), b AS (SELECT query, arg_min(id, rank) AS y FROM jac_ranked GROUP BY 1) SELECT query, x = y AS same_top FROM a JOIN b USING (query)")
def s_topk_jaccard_eval(t):
    a = S.bm25(_terms(t), _asked(t), 1, t.documents.count()).select("query", F.col("id").alias("x"))
    b = S.overlap(t.documents, "doc_id", "text", _questions(t), 1).select("query", F.col("id").alias("y"))
    return a.join(b, "query").select("query", (F.col("x") == F.col("y")).alias("same_top"))


_KNN = "WITH p AS (SELECT q.vec_id AS query, c.vec_id AS id, round({d}, 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p) "
_L2 = _KNN.format(d="list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)))")
_COS = _KNN.format(d="1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])")


def _knn(t: Tables, metric: str) -> DataFrame:
    return V.nearest(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, metric)


@query("s_knn_l2", _L2 + "SELECT query, id, distance, rank FROM r WHERE rank <= 10")
def s_knn_l2(t):
    return _knn(t, "l2")


@query("s_knn_score", _L2 + "SELECT query, id, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= 10")
def s_knn_score(t):
    return _knn(t, "l2").select("query", "id", F.round(1 / (1 + F.col("distance")), 6).alias("score"))


@query("s_knn_cosine", _COS + "SELECT query, id, distance, rank FROM r WHERE rank <= 10 AND distance < 0.5")
def s_knn_cosine(t):
    return _knn(t, "cosine").where("distance < 0.5")


def _doc_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.words(F.col("text")).alias("w"))


@query("s_tokenize_default", f"SELECT doc_id, {_DEFAULT.format(t='text')} AS tokens FROM documents")
def s_tokenize_default(t):
    return t.documents.select("doc_id", X.default_tokens(F.col("text")).alias("tokens"))


@query("s_tokenize_code", r"SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) > 1) AS tokens FROM documents")
def s_tokenize_code(t):
    return t.documents.select("doc_id", X.code_tokens(F.col("text")).alias("tokens"))


@query("s_tokenize_semantic", f"SELECT doc_id, {_SEMANTIC.format(t='text')} AS tokens FROM documents")
def s_tokenize_semantic(t):
    return t.documents.select("doc_id", X.semantic_tokens(F.col("text")).alias("tokens"))


@query("s_query_terms", f"SELECT item_id, list_slice(list_distinct_keep, 1, 16) AS terms FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x) AS list_distinct_keep FROM (SELECT item_id, {_TOK.format(t='text')} AS w FROM benchmark))")
def s_query_terms(t):
    return t.benchmark.select("item_id", F.slice(F.array_distinct(X.words(F.col("text"))), 1, 16).alias("terms"))


@query("agg_corpus_stats", f"SELECT count(*) AS docs, sum(len(w))::BIGINT AS tokens, round(avg(len(w)), 6) AS avg_tokens FROM (SELECT {_TOK.format(t='text')} AS w FROM documents)")
def agg_corpus_stats(t):
    return _doc_words(t).agg(F.count("*").alias("docs"), F.sum(F.size("w")).alias("tokens"), F.round(F.avg(F.size("w")), 6).alias("avg_tokens"))


@query("agg_qa_stats", "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length FROM conversations GROUP BY role")
def agg_qa_stats(t):
    n = F.length("text").cast("long")
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avg_length"), F.max(n).alias("max_length"))


@query("filter_grep", "SELECT doc_id, i AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(l, '(?i)licen[cs]ed under')")
def filter_grep(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.where(F.col("text").rlike("(?i)licen[cs]ed under")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "text")


@query("scan_read_range", "SELECT doc_id, i AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE i BETWEEN 2 AND 4")
def scan_read_range(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.where("i between 1 and 3").select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "text")


@query("s_snippet", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), s AS (SELECT *, (length(l) - length(replace(lower(l), 'the', ''))) // 3 AS n FROM l) SELECT doc_id, i AS line, n FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1")
def s_snippet(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    n = F.floor((F.length("l") - F.length(F.replace(F.lower("l"), F.lit("the"), F.lit("")))) / 3)
    best = lines.withColumn("n", n).where("n > 0").groupBy("doc_id").agg(F.max_by(F.struct((F.col("i") + 1).alias("line"), "n"), F.struct("n", -F.col("i"))).alias("x"))
    return best.select("doc_id", F.col("x.line").cast("long").alias("line"), F.col("x.n").alias("n"))


@query("q_total_loc", "SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS loc FROM documents GROUP BY source")
def q_total_loc(t):
    return t.documents.groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).alias("loc"))


@query("q_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def q_token_estimate(t):
    return t.documents.select("doc_id", F.ceil(F.length("text") / 4.0).alias("tokens"))


@query("q_file_fingerprint", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def q_file_fingerprint(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("filter_binary", "SELECT doc_id FROM documents WHERE length(regexp_replace(substr(text, 1, 1000), '[\\x20-\\x7e\\n\\t]', '', 'g')) > 0.1 * length(substr(text, 1, 1000))".replace("substr(text, 1, 1000)", "text"))
def filter_binary(t):
    return t.documents.where(F.length(F.regexp_replace("text", "[\\x20-\\x7e\\n\\t]", "")) > 0.1 * F.length("text")).select("doc_id")


@query("scan_ls", "SELECT url, lower(url) AS name FROM pages ORDER BY lower(url), url LIMIT 200")
def scan_ls(t):
    return t.pages.select("url", F.lower("url").alias("name")).orderBy("name", "url").limit(200)


@query("scan_glob", "SELECT url FROM pages WHERE url LIKE '%/%' ORDER BY url LIMIT 200")
def scan_glob(t):
    return t.pages.where(F.col("url").like("%/%")).select("url").orderBy("url").limit(200)


@query("q_path_info", "SELECT page_id, regexp_replace(url, '^.*/', '') AS base, len(string_split(url, '/'))::BIGINT AS depth FROM pages")
def q_path_info(t):
    return t.pages.select("page_id", X.basename(F.col("url")).alias("base"), F.size(F.split("url", "/")).cast("long").alias("depth"))


@query("f_slug", "SELECT n_nationkey, lower(substr(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g'), 1, 20)) AS slug, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS name FROM nation")
def f_slug(t):
    return t.nation.select("n_nationkey", X.slug(F.col("n_name")).alias("slug"), X.capitalize(F.lower("n_name")).alias("name"))


@query("f_clean_ws", r"SELECT doc_id, regexp_replace(trim(text, ' '), '[ \t\n]+', ' ', 'g') AS text FROM documents")
def f_clean_ws(t):
    return t.documents.select("doc_id", X.clean_space(F.col("text")).alias("text"))


@query("q_error_classify", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 75 THEN 'fatal' WHEN event_type = 'error' THEN 'retry' ELSE 'none' END AS class FROM events")
def q_error_classify(t):
    return t.events.select("event_id", F.when((F.col("event_type") == "error") & (F.col("value") > 75), "fatal").when(F.col("event_type") == "error", "retry").otherwise("none").alias("class"))


@query("s_error_similarity", "WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda w: length(w) > 1)) AS s FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6)::DOUBLE AS similarity FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def s_error_similarity(t):
    c = t.conversations.select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("s"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("z"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("s"), F.col("z")), 6).alias("similarity"))


@query("win_topic_shift", "WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda w: length(w) > 1)) AS s FROM conversations) SELECT conv_id, turn, p IS NOT NULL AND len(list_intersect(s, p)) < 2 AS shift FROM (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)")
def win_topic_shift(t):
    from pyspark.sql import Window as W

    c = t.conversations.select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("s"))
    p = F.lag("s").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("p", p).select("conv_id", "turn", F.coalesce(F.size(F.array_intersect("s", "p")) < 2, F.lit(False)).alias("shift"))


@query("q_batch_query", _TERMS + " SELECT query, count(DISTINCT id) AS docs FROM terms JOIN asked USING (term) GROUP BY query")
def q_batch_query(t):
    return S.term_rows(_terms(t)).join(_asked(t), "term").groupBy("query").agg(F.count_distinct("id").alias("docs"))


@query("s_label_eval", _TERMS + _BM25 + " SELECT query, sum(quality)::BIGINT AS good, count(*) AS labelled FROM bm_ranked JOIN labels ON id = doc_id WHERE rank <= 20 GROUP BY query")
def s_label_eval(t):
    h = S.bm25(_terms(t), _asked(t), 20, t.documents.count()).join(t.labels, F.col("id") == F.col("doc_id"))
    return h.groupBy("query").agg(F.sum("quality").alias("good"), F.count("*").alias("labelled"))
