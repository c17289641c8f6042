"""Loan features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value; null stays null (least/greatest would skip it)."""
    out = value
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    return out


def rate_spread(current: str = "current_interest_rate", original: str = "original_interest_rate") -> Column:
    return F.col(current) - F.col(original)


def upb_amortization(current: str = "current_actual_upb", original: str = "original_upb") -> Column:
    """Share of the original balance repaid, limited to 0..1."""
    return clip(F.lit(1.0) - F.try_divide(F.col(current), F.col(original)), 0.0, 1.0)


def yes_or_past(flag: str) -> Column:
    """1 for flag Y or P, else 0."""
    return F.coalesce(F.col(flag).isin("Y", "P"), F.lit(False)).cast("int")


def known_eltv(value: str = "estimated_loan_to_value_eltv") -> Column:
    return F.nullif(F.col(value), F.lit(999))
