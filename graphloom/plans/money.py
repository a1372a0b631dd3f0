"""Queries of the finance functions and of text and array scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import finance as M
from graphloom.plans.book import query
from graphloom.sources import sinks

_R = "(c_custkey % 10 + 1) / 100.0::DOUBLE"
_N = "(c_custkey % 5 + 1)"


def _c(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("a"), ((F.col("c_custkey") % 10 + 1) / 100.0).alias("r"), (F.col("c_custkey") % 5 + 1).alias("n"))


@query("m_fv", f"SELECT c_custkey, round(c_acctbal * pow(1 + {_R}, {_N}), 4) AS fv FROM customer")
def m_fv(t):
    return _c(t).select("c_custkey", F.round(M.future_value(F.col("a"), F.col("r"), F.col("n")), 4).alias("fv"))


@query("m_pv", f"SELECT c_custkey, round(c_acctbal / pow(1 + {_R}, {_N}), 4) AS pv FROM customer")
def m_pv(t):
    return _c(t).select("c_custkey", F.round(M.present_value(F.col("a"), F.col("r"), F.col("n")), 4).alias("pv"))


@query("m_loan_payment", f"SELECT c_custkey, round(c_acctbal * {_R} * pow(1 + {_R}, {_N}) / (pow(1 + {_R}, {_N}) - 1), 4) AS payment FROM customer")
def m_loan_payment(t):
    return _c(t).select("c_custkey", F.round(M.loan_payment(F.col("a"), F.col("r"), F.col("n")), 4).alias("payment"))


@query("m_ear", f"SELECT c_custkey, round(pow(1 + {_R} / 12, 12) - 1, 8) AS ear, round(72 / ({_R} * 100), 6) AS double_years FROM customer")
def m_ear(t):
    return _c(t).select("c_custkey", F.round(M.effective_rate(F.col("r"), F.lit(12)), 8).alias("ear"), F.round(M.rule_72(F.col("r") * 100), 6).alias("double_years"))


@query("m_roi", f"SELECT c_custkey, round(CASE WHEN c_acctbal = 0 THEN 0 ELSE (c_acctbal * (1 + {_R}) - c_acctbal) / c_acctbal END, 6) AS roi, round(pow(1 + {_R}, 1.0 / {_N}) - 1, 8) AS annual FROM customer")
def m_roi(t):
    return _c(t).select("c_custkey", F.round(M.return_on_investment(F.col("a") * (1 + F.col("r")), F.col("a")), 6).alias("roi"), F.round(M.annualized(F.col("r"), F.col("n")), 8).alias("annual"))


def _flows(t):
    """Per customer the sums of orders by year, the first one paid out."""
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    rows = y.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("f"))
    return rows.select("o_custkey", F.transform("f", lambda x, i: F.when(i == 0, -x["v"]).otherwise(x["v"])).alias("flows"))


@query("m_npv", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y) - 1 AS i FROM y) SELECT o_custkey, round(sum(CASE WHEN i = 0 THEN -v ELSE v END / pow(1.05, i)), 2) AS npv FROM f GROUP BY o_custkey")
def m_npv(t):
    return _flows(t).select("o_custkey", F.round(M.net_present_value(F.col("flows"), F.lit(0.05)), 2).alias("npv"))


@query("m_irr")
def m_irr(t):
    return _flows(t).select("o_custkey", F.round(M.internal_rate(F.col("flows")), 6).alias("irr"))


@query("sink_dot", "SELECT '  \"' || n_name || '\" -> \"' || r_name || '\";' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_dot(t):
    return sinks.dot_lines(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("caller"), F.col("r_name").alias("callee")))
