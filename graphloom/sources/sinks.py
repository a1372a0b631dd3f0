"""Sinks: CSV with every field quoted, keyed JSON, DOT text and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, every field quoted and control characters taken out."""
    clean = [F.regexp_replace(F.replace(F.col(c), F.lit("\r\n"), F.lit("\n")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def keyed_json(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in a folder for each key; only the folders of keys in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of a graph view, one JSON text a row."""
    return nodes.select(F.to_json(F.struct(F.struct(*nodes.columns).alias("data"))).alias("element")).union(edges.select(F.to_json(F.struct(F.struct(*edges.columns).alias("data")))))


def dot_lines(edges: DataFrame) -> DataFrame:
    """DOT statements of edges, in order."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col("caller").cast("string"), F.col("callee").cast("string")).alias("line")).orderBy("line")


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """A small result as a Markdown table of at most ``most`` rows."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
