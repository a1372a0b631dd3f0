"""Text functions as column expressions: tokenisers, cleaning, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stopwords of the default tokeniser (fixed values).
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "what", "which",
    "who", "when", "where", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "no", "not", "only",
    "same", "so", "than", "too", "very", "just", "if", "else", "then",
)

#: Words that an index of source files leaves out (fixed values).
INDEX_STOPWORDS = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while",
    "class", "new", "this", "import", "export", "from", "default", "async", "await",
    "try", "catch", "throw", "typeof", "instanceof", "true", "false", "null", "undefined",
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with",
    "to", "of", "it", "be", "as", "by", "that", "for", "are", "was", "were",
)
#: Where such an index parts words (a fixed value).
INDEX_BREAKS = r"""[\s\-_./\\(){}\[\]<>:;,!?'"]+"""


def _whole(pattern: str) -> Column:
    """Matches that no letter, digit or underscore of any script stands beside."""
    return F.lit(rf"(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits that start with a letter, two characters at least."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+"), F.lit(0))


def default_tokens(text: Column) -> Column:
    """Camel case and ``_-/`` parted, lower-case; whole words of two characters or more, letter first, without stopwords."""
    parted = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), r"[_\-/]", " ")
    return F.filter(F.regexp_extract_all(F.lower(parted), _whole("[a-z][a-z0-9]++"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def code_tokens(text: Column) -> Column:
    """Camel case and underscores parted, letters and digits, no stopwords taken out."""
    parted = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.filter(F.regexp_extract_all(F.lower(parted), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)


def semantic_tokens(text: Column) -> Column:
    """Lower-cased first, parted at ``_-/\\.``; whole words of two letters or digits and more."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.trim(text)), r"[_\-/\\.]", " "), _whole("[a-z0-9]{2,}+"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Lower-case words between white space and punctuation, two characters or more, without an index's stopwords."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), INDEX_BREAKS), lambda w: (F.length(w) > 1) & ~w.isin(*INDEX_STOPWORDS))


def bigrams(text: Column) -> Column:
    """Character bigrams of a run (for scripts without spaces)."""
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array(text))


def normalize_text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def clean_space(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "[ \\t\\n]+", " ")


def slug(x: Column) -> Column:
    """Not letters or digits to ``_``, 20 characters, lower-case."""
    return F.lower(F.substring(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), 1, 20))


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def truncate_word(x: Column, n: int) -> Column:
    """The first n characters, cut at the last space if that is past four fifths."""
    head = F.substring(x, 1, n)
    at = F.lit(n) - F.locate(" ", F.reverse(head)) + 1
    return F.when(F.length(x) <= n, x).when((F.locate(" ", F.reverse(head)) > 0) & (at > 0.8 * n), F.substr(head, F.lit(1), at - 1)).otherwise(head)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def naming_style(name: Column) -> Column:
    return F.when(name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake").when(name.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal").when(name.rlike("^[a-z]+[A-Z][A-Za-z0-9]*$"), "camel").when(name.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab").otherwise("other")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; empty ones have none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
