"""The engine's inputs, bound to the fixture tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def calls(lineitem: DataFrame) -> DataFrame:
    """(caller, callee): consecutive parts of an order, without loops and repeats."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lineitem.select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"))
    return pairs.where("callee is not null and caller <> callee").distinct()


def membership(part: DataFrame) -> DataFrame:
    """(node, part, func): the community and the function layer of a node."""
    return part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("part"), F.col("p_type").alias("func"))


def location(lineitem: DataFrame) -> DataFrame:
    """(node, file): where a node is defined."""
    return lineitem.groupBy(F.col("l_partkey").alias("node")).agg(F.min("l_suppkey").alias("file"))


def ledger(orders: DataFrame) -> DataFrame:
    """(id, date, type, category, amount)."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "income").otherwise("expense").alias("type"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def extends(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(child, parent): a forest of names, customers under nations under regions."""
    up = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    low = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"]).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"))
    return up.unionByName(low)


def event_log(events: DataFrame) -> DataFrame:
    """(key, seq, event_id, type, ts, value): events numbered per user in order of time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("key"), F.row_number().over(w).cast("long").alias("seq"), "event_id", F.col("event_type").alias("type"), "ts", "value")


#: The module that stands for a part, by lines; braces are the part's columns.
MODULE = (
    "import os",
    "from lib import helper",
    "",
    "",
    "class C{p_partkey}(Base{p_size % 5}):",
    '    """{p_name} of {p_type}."""',
    "",
    "    def m{p_partkey}(self, x):",
    "        # keep {p_size}",
    "        self.size = x",
    "        if x:",
    "            y = helper(self.brand)",
    "        return y",
)


def _joined(quoted: str, text: str, column: str) -> str:
    """The SQL of a text with columns in braces."""
    pieces = re.split(r"\{(.*?)\}", text)
    return " || ".join(quoted.format(x) if i % 2 == 0 else column.format(x) for i, x in enumerate(pieces) if x)


#: Modules that a task parses.
MODULES = 4096


def sources(part: DataFrame) -> DataFrame:
    """(path, content, key, p_name, p_type, size): a Python module for each part, in a folder for each brand.

    A small table of parts makes much work, so its rows are dealt out first: a
    file that Spark reads in one task would be parsed in one task.
    """
    part = part.repartition(1 + part.count() // MODULES)
    lines = F.concat_ws("\n", *[F.expr(_joined("'{}'", x, "cast({} as string)") or "''") for x in MODULE])
    path = F.expr("concat('src/', replace(p_brand, '#', ''), '/m', p_partkey, '.py')")
    return part.select(path.alias("path"), F.concat(lines, F.lit("\n")).alias("content"), F.col("p_partkey").alias("key"), "p_name", "p_type", F.col("p_size").alias("size"))


#: The same bindings for the SQL twins.
SQL = {
    "calls": "calls AS (SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee FROM lineitem) WHERE callee IS NOT NULL AND caller <> callee)",
    "member": "member AS (SELECT p_partkey AS node, p_brand AS part, p_type AS func FROM part)",
    "location": "location AS (SELECT l_partkey AS node, min(l_suppkey) AS file FROM lineitem GROUP BY 1)",
    "ledger": "ledger AS (SELECT o_orderkey AS id, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN 'income' ELSE 'expense' END AS type, o_orderpriority AS category, o_totalprice::DECIMAL(18,2) AS amount FROM orders)",
    "extends": "extends AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "sources": "sources AS (SELECT 'src/' || replace(p_brand, '#', '') || '/m' || p_partkey || '.py' AS path, " + " || chr(10) || ".join(_joined("'{}'", x, "({})::VARCHAR") or "''" for x in MODULE) + " || chr(10) AS content, p_partkey AS key, p_name, p_type, p_size AS size FROM part)",
    "log": "log AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type AS type, ts, value FROM events)",
}


def with_(*names: str, recursive: bool = False) -> str:
    """A WITH clause of bindings, to be followed by further ones or a SELECT."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names) + " "
