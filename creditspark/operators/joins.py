"""Joins of the loan tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning
from creditspark.scale import bounded_broadcast


def build_panel(
    performance: DataFrame, origination: DataFrame, key: str = schema.LOAN,
    unique_loans: bool = False, trimmed: bool = False,
) -> DataFrame:
    """Every performance row with its loan's origination columns.

    The origination vintage replaces the performance one (null for rows without a
    loan); other shared names get the suffix `_orig`.  Keys are trimmed before the
    join, so the exchange on the key also serves the loan windows after it.  Tables stored in buckets
    have `trimmed` keys already and need no exchange.
    """
    left, right = performance, origination
    if not trimmed:
        left, right = (df.withColumn(key, cleaning.join_key(key)) for df in (performance, origination))
    if unique_loans:
        right = right.dropDuplicates([key])
    if schema.VINTAGE in right.columns:
        left = left.drop(schema.VINTAGE)
    shared = [c for c in right.columns if c in left.columns and c != key]
    return left.join(right.withColumnsRenamed({c: f"{c}_orig" for c in shared}), key, "left")


def panel_of_all_loans(performance: DataFrame, origination: DataFrame, key: str = schema.LOAN) -> DataFrame:
    """Every loan with its months; a loan without months keeps one row."""
    left = origination.withColumn(key, cleaning.join_key(key))
    right = performance.withColumn(key, cleaning.join_key(key))
    shared = [c for c in right.columns if c in left.columns and c != key]
    return left.join(right.withColumnsRenamed({c: f"{c}_perf" for c in shared}), key, "left")


def with_macro(
    panel: DataFrame, macro: DataFrame | None, month: str = schema.MONTH, date: str = "date",
) -> DataFrame:
    """Monthly macro columns by reporting month; unchanged if there is no macro table.

    The macro table has one row per calendar month, so it is broadcast once its
    size is checked and the panel is not shuffled.
    """
    if macro is None:
        return panel
    table = bounded_broadcast(macro.withColumnRenamed(date, "_date"), 20_000)
    return panel.join(table, F.col(month) == F.col("_date"), "left").drop("_date")


def loan_flag(performance: DataFrame, flag: Column | str, name: str, key: str = schema.LOAN) -> DataFrame:
    """Per loan the largest known value of a 0/1 flag."""
    value = F.col(flag) if isinstance(flag, str) else flag
    return performance.groupBy(key).agg(F.max(value.cast("int")).alias(name))


def loans_with_flag(
    origination: DataFrame, flags: DataFrame, key: str = schema.LOAN, keep_all: bool = False,
) -> DataFrame:
    """Loans with their per-loan flag; loans without months only if `keep_all`."""
    loans = origination.withColumn(key, cleaning.join_key(key))
    return loans.join(flags, key, "left" if keep_all else "inner")


def orphan_rows(performance: DataFrame, origination: DataFrame, key: str = schema.LOAN) -> DataFrame:
    """Performance rows without a loan."""
    left = performance.withColumn(key, cleaning.join_key(key))
    right = origination.select(cleaning.join_key(key).alias(key))
    return left.join(right, key, "left_anti")


def orphan_check(
    performance: DataFrame, origination: DataFrame, key: str = schema.LOAN, probe: str = "credit_score",
) -> DataFrame:
    """Rows, rows without a loan, and rows with a null probe (which mixes in cleared codes)."""
    left = performance.select(cleaning.join_key(key).alias(key))
    right = origination.select(cleaning.join_key(key).alias(key), probe, F.lit(1).alias("_found"))
    missing = lambda c: F.sum(F.col(c).isNull().cast("long"))
    return left.join(right, key, "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        missing("_found").alias("n_orphan"),
        missing(probe).alias("n_probe_null"),
    )


def loan_lookup(df: DataFrame, loan: str, key: str = schema.LOAN) -> DataFrame:
    """All rows of one loan; the comparison reaches the parquet scan."""
    return df.filter(F.col(key) == loan)


def first_occurrence(
    df: DataFrame, condition: Column, key: str = "id_loan", month: str = "period",
) -> DataFrame:
    """Rows that meet the condition in the first month their loan does; ties are kept."""
    kept = df.filter(condition)
    first = kept.groupBy(key).agg(F.min(month).alias(month))
    return kept.join(first, [key, month], "left_semi").distinct()


def rows_of_flagged_loans(df: DataFrame, condition: Column, key: str = "id_loan") -> DataFrame:
    """All rows of the loans that meet the condition at least once."""
    return df.join(df.filter(condition).select(key).distinct(), key, "left_semi")
