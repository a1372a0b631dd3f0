"""Finance functions: closed forms as column expressions, the internal rate by Newton's method."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def future_value(pv: Column, r: Column, n: Column) -> Column:
    return pv * F.pow(1 + r, n)


def present_value(fv: Column, r: Column, n: Column) -> Column:
    return fv / F.pow(1 + r, n)


def loan_payment(principal: Column, r: Column, n: Column) -> Column:
    """Annuity per period; without interest the even share."""
    return F.when(r == 0, principal / n).otherwise(principal * r * F.pow(1 + r, n) / (F.pow(1 + r, n) - 1))


def net_present_value(flows: Column, r: Column) -> Column:
    """Of an array of flows, the first now."""
    pairs = F.transform(flows, lambda x, i: x / F.pow(1 + r, i))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def return_on_investment(gain: Column, cost: Column) -> Column:
    return F.when(cost == 0, 0.0).otherwise((gain - cost) / cost)


def annualized(total: Column, years: Column) -> Column:
    return F.when(years <= 0, 0.0).otherwise(F.pow(1 + total, 1 / years) - 1)


def rule_72(rate: Column) -> Column:
    """Years to double at a rate in percent; infinite at none."""
    return F.when(rate <= 0, F.lit(float("inf"))).otherwise(72 / rate)


def effective_rate(r: Column, n: Column) -> Column:
    return F.pow(1 + r / n, n) - 1


def irr(flows: list[float], start: float = 0.1, most: int = 1000, near: float = 1e-6) -> float | None:
    """The rate at which flows are worth nothing now; None for fewer than two or where Newton's method stalls."""
    if flows is None or len(flows) < 2:
        return None
    r = start
    for _ in range(most):
        if r <= -1:
            return None
        value = sum(c / (1 + r) ** k for k, c in enumerate(flows))
        slope = sum(-k * c / (1 + r) ** (k + 1) for k, c in enumerate(flows))
        if abs(slope) < 1e-12:
            return None
        step = value / slope
        r -= step
        if abs(step) < near:
            return r
    return None


def internal_rate(flows: Column) -> Column:
    @F.pandas_udf("double")
    def rates(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: irr(None if x is None else list(x)))

    return rates(flows)
