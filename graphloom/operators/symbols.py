"""Symbol hunting: definitions in the files that match a query best, scored by the query's words and identifiers.

Definitions are found once in all files, whatever the queries; a query meets
those of its best files only, so no pair of a query and a file outside them is
looked at.  Everything is an expression or an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.operators import matching as M

#: Files of a query that are looked into, and words that it looks for (fixed values).
FILES, TERMS = 60, 30
_NAME = "([A-Za-z_][A-Za-z0-9_]*)"
#: What opens a definition, in the order that counts (fixed values).
DEFINITIONS = (
    rf"^\s*def\s+{_NAME}\s*\(",
    rf"^\s*class\s+{_NAME}\b",
    rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{_NAME}\s*\(",
    rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\(",
    rf"^\s*(?:export\s+)?class\s+{_NAME}\b",
)


def symbol_terms(text: Column) -> Column:
    """Up to 24 distinct words of a query and the parts of its names: at dots, underscores and changes of case."""
    names = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_.]+"), F.lit(0))
    parts = lambda t: F.concat(F.split(F.translate(t, "._", "  "), " +"), F.regexp_extract_all(t, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"), F.lit(0)))
    good = F.filter(F.transform(F.flatten(F.transform(names, parts)), F.lower), lambda w: (F.length(w) >= 2) & ~w.isin(*M.STOPWORDS))
    return F.slice(F.array_distinct(F.concat(M.query_terms(text), good)), 1, 24)


def definitions(docs: DataFrame) -> DataFrame:
    """(id, line, symbol): the first definition of each name, whatever its case, in each file (id, text); lines from 1."""
    lines = docs.where("id is not null").select("id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    symbol = F.coalesce(*[F.nullif(F.regexp_extract("line", d, 1), F.lit("")) for d in DEFINITIONS])
    found = lines.select("id", (F.col("n") + 1).cast("long").alias("line"), symbol.alias("symbol")).where("symbol is not null")
    return found.groupBy("id", F.lower("symbol").alias("_low")).agg(F.min_by("symbol", "line").alias("symbol"), F.min("line").alias("line")).select("id", "line", "symbol")


def query_words(plans: DataFrame) -> DataFrame:
    """(query, terms, names, hints): what all plans of a query look for, those of the first plans first."""
    each = plans.select("query", F.struct("plan", symbol_terms(F.col("text")).alias("t"), M.exact_identifiers(F.col("text")).alias("n"), M.path_hints(F.col("text")).alias("h")).alias("p"))
    ordered = each.groupBy("query").agg(F.array_sort(F.collect_list("p")).alias("p"))  # six plans at most
    whole = lambda c, most: F.slice(F.array_distinct(F.transform(F.flatten(F.transform("p", lambda p: p[c])), F.lower)), 1, most)
    return ordered.select("query", whole("t", TERMS).alias("terms"), whole("n", 20).alias("names"), whole("h", 12).alias("hints"))


def _points(words: str, equal: int, inside: int) -> Column:
    """Tenths for each word that is the symbol, or is in it."""
    low = F.lower("symbol")
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.when(w == low, equal).when(F.contains(low, w), inside).otherwise(0))


def symbol_hits(docs: DataFrame, plans: DataFrame, best: DataFrame, top: int) -> DataFrame:
    """(query, id, symbol, line, score): the first ``top`` symbols in a query's best files (query, id, score, rank) that its words touch.

    A word counts 6 if it is the symbol and 2.8 if it is in it, an identifier 16
    and 4; 1.2 more for a hint in the path, up to 1.4 for the file's rank, and
    0.35 of the file's own score.
    """
    files = best.where(F.col("rank") <= FILES).select("query", "id", F.col("score").alias("base"), "rank")
    paths = docs.select("id", F.lower(F.coalesce("path", F.lit(""))).alias("path"))
    x = files.join(definitions(docs), "id").join(paths, "id").join(query_words(plans), "query")
    tenths = _points("terms", 60, 28) + _points("names", 160, 40)
    hinted = F.exists("hints", lambda h: (F.regexp_extract(h, "[^/]*$", 0) != "") & F.contains("path", F.regexp_extract(h, "[^/]*$", 0)))
    score = F.col("tenths") / 10 + F.when(hinted, 1.2).otherwise(0.0) + F.greatest(F.lit(0.0), 1.4 - F.col("rank") * 0.03) + F.col("base") * 0.35
    hits = x.withColumn("tenths", tenths).where("tenths > 0").select("query", "id", "symbol", "line", F.round(score, 4).alias("score"), "rank")
    place = F.row_number().over(W.partitionBy("query").orderBy("rank", "line"))
    return hits.withColumn("n", place).where(F.col("n") <= top).select("query", "id", "symbol", "line", "score")
