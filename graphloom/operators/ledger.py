"""Ledger operators: filters, balances and summaries of (id, date, type, category, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(kind: str) -> Column:
    return F.sum(F.when(F.col("type") == kind, F.col("amount")).otherwise(0))


def balance(ledger: DataFrame) -> DataFrame:
    """Income less expense."""
    return ledger.agg((of_type("income") - of_type("expense")).cast("double").alias("balance"))


def total(ledger: DataFrame, kind: str) -> DataFrame:
    return ledger.agg(of_type(kind).cast("double").alias("total"))


def summary(ledger: DataFrame) -> DataFrame:
    """Totals by category and over all (category null), by grouping sets."""
    both = ledger.rollup("category").agg(of_type("income").cast("double").alias("income"), of_type("expense").cast("double").alias("expense"), F.count("*").alias("n"))
    return both


def filtered(ledger: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None, kind: str | None = None) -> DataFrame:
    """All given conditions together; dates are inclusive."""
    tests = [("date", ">=", start), ("date", "<=", end), ("category", "==", category), ("type", "==", kind)]
    for column, op, value in tests:
        if value is not None:
            c, v = F.col(column), F.lit(value).cast("date") if column == "date" else F.lit(value)
            ledger = ledger.where(c >= v if op == ">=" else c <= v if op == "<=" else c == v)
    return ledger


def projected(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen fields; those missing are null."""
    return rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is absent are added; those present replace."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)
