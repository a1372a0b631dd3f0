"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    from graphloom.llm.mixing import mix_report

    return mix_report(_docs(spark, sf_dir)).drop("source")


def op2_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, as read back from the written shards."""
    import uuid

    import public_tokenizers

    from graphloom.llm.cluster import shared_dir
    from graphloom.llm.repair_ids import read_shards, write_shards

    path = f"{shared_dir(spark)}/graphloom/token-shards-{uuid.uuid4().hex}"
    write_shards(_docs(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path, digest=True)


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    from graphloom.llm.pii_crf import personal_data

    return personal_data(_docs(spark, sf_dir))


def op4_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from graphloom.llm.chosen_path import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op5_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents; the source is the host."""
    from graphloom.llm.line_frequency import line_frequency

    verdicts, _ = line_frequency(_docs(spark, sf_dir))
    return verdicts.drop("host")


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's piece ids, and whether they decode to the text."""
    from graphloom.llm.piece_transducer import digests

    return digests(_docs(spark, sf_dir))


def op7_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-mixing scores of all documents."""
    from graphloom.llm.context_mixing import lm_scores

    return lm_scores(_docs(spark, sf_dir))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poor-quality and toxicity probabilities of all documents, and the verdict."""
    from graphloom.llm.toxicity_chain import THRESHOLD, standard_chain

    docs = _docs(spark, sf_dir)
    chain = standard_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chain.score(docs).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    from graphloom.llm.license_rules import license_scan

    return license_scan(_docs(spark, sf_dir)).drop("detections")


def op10_multi_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes, of all, to those whose id 20 divides."""
    from graphloom.llm.mih_topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents, of all, for every benchmark item."""
    from graphloom.llm.maxscore import top_documents

    return top_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hardest negatives of each of five positives, for the rows whose id 50 divides."""
    from graphloom.llm.pivot_mining import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 50 == 0)


def op13_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    from graphloom.llm.bpe_counts import token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_subset_sum_mix, op2_repair_token_ids, op3_skip_chain_pii, op4_chosen_path_near_dedup, op5_line_frequency_quality, op6_piece_transducer, op7_context_mixing_lm, op8_toxicity_chain, op9_license_rules, op10_multi_index_top_k, op11_maxscore_search, op12_pivot_hard_negatives, op13_heap_bpe_counts)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

_OP4 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM meets JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM ways UNION SELECT r.doc_id, b.b FROM reach r JOIN ways b ON r.other = b.a),
comp AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.least, s.doc_id)) AS kept
FROM sets s LEFT JOIN comp c ON s.doc_id = c.doc_id
"""

_OP5 = rf"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT g.doc_id, g.i, unnest(range(0, 5)) AS k FROM grams g JOIN twice t ON g.doc_id = t.doc_id AND g.g = t.g) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, line, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(regexp_extract_all(line, {_WORD})) AS words
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, {_WORD})),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
frequent AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY ALL) WHERE n > 20),
gone AS (SELECT doc_id, sum(words) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY doc_id),
figures AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS removed_words
  FROM base b LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN gone g USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= n_words * 0.3 AS kept FROM judged
"""

_OP10 = """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM codes q, codes c WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11 = f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
sizes AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_words FROM d WHERE len(t) > 0),
posts AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posts, sizes GROUP BY term, n_docs),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN posts USING (term) JOIN weights USING (term), sizes GROUP BY item_id, row, doc_id HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""

_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

def _op9() -> str:
    """The scan in SQL: words stand with a space on either side, so that neighbouring matches share none."""
    from graphloom.llm.license_rules import BASE, BASE_SCORE, TRIGGERS, rules

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    doubled = lambda x: x.replace(" ?", "(?:@)?").replace(" ", "  ").replace("@", "  ")
    table = ", ".join(f"({k}, {r[0]}, {quoted(r[1])}, {quoted(r[2])}, {quoted(' (' + doubled(r[3]) + ') ')}, {r[4]}::DOUBLE)" for k, r in enumerate(rules()))
    places = " UNION ALL ".join(f"SELECT doc_id, {quoted(label)} AS label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) - {phrase.count(' ') - 1})) AS i FROM d) WHERE w[i:i + {phrase.count(' ')}] = {phrase.split()}" for phrase, label in BASE.items())
    live = " OR ".join(f"contains(norm, {quoted(t)})" for t in TRIGGERS)
    return rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM documents),
d AS (SELECT doc_id, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM t),
rules(rule, priority, label, keyword, pattern, score) AS (VALUES {table}),
places AS ({places}),
marked AS (
  SELECT doc_id, rule, priority, label, score, string_split(regexp_replace(' ' || replace(norm, ' ', '  ') || ' ', pattern, chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts
  FROM (SELECT * FROM d WHERE {live}) JOIN rules ON contains(norm, keyword)),
parts AS (SELECT doc_id, rule, priority, label, score, i, parts[i] AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM marked WHERE len(parts) > 1)),
sized AS (
  SELECT *, CASE WHEN i = 1 THEN 0 ELSE (length(split_part(part, chr(2), 1)) - length(replace(split_part(part, chr(2), 1), ' ', ''))) // 2 + 1 END AS size,
         CASE WHEN i = 1 THEN (length(part) - length(replace(part, ' ', ''))) // 2
              ELSE (length(split_part(part, chr(2), 2)) - length(replace(split_part(part, chr(2), 2), ' ', ''))) // 2 END AS rest FROM parts),
hits AS (
  SELECT doc_id, rule, priority, label, score, i, a, a + size AS b
  FROM (SELECT *, coalesce(sum(size + rest) OVER (PARTITION BY doc_id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sized) WHERE i > 1),
kept AS (
  SELECT * FROM hits x WHERE NOT EXISTS (
    SELECT 1 FROM hits y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.b >= x.b
    AND (y.priority < x.priority OR (y.priority = x.priority AND (y.b - y.a > x.b - x.a OR (y.b - y.a = x.b - x.a AND y.label < x.label)))))),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM kept) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(x.labels, '') AS labels,
       greatest(coalesce(s.score, 0), CASE WHEN n > 0 THEN {BASE_SCORE}::DOUBLE ELSE 0 END) AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN named x USING (doc_id) LEFT JOIN best s USING (doc_id)
"""


ORACLES: dict[str, str] = {"op4_chosen_path_near_dedup": _OP4, "op5_line_frequency_quality": _OP5, "op9_license_rules": _op9(), "op10_multi_index_top_k": _OP10, "op11_maxscore_search": _OP11, "op12_pivot_hard_negatives": _OP12}
