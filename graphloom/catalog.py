"""The named queries over the fixture tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import evidence, graphs, money, projects, relational, retrieval, scalars, secondary, streams  # noqa: F401
from graphloom.plans.book import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    return QUERIES["s_hybrid_graph"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
