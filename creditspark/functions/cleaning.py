"""Cleaning of raw columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark import schema


def normalize_columns(df: DataFrame) -> DataFrame:
    """Drop a positional `_V<n>` suffix; `year` becomes `vintage_year` if that is absent."""
    names = [re.sub(r"_V\d+$", "", c) for c in df.columns]
    if "year" in names and schema.VINTAGE not in names:
        names[names.index("year")] = schema.VINTAGE
    return df.toDF(*names)


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns of `names` that exist."""
    return df.withColumnsRenamed(dict(names))


def first_present(df: DataFrame, *options: str) -> str | None:
    """The first of `options` that is a column."""
    return next((c for c in options if c in df.columns), None)


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def missing_features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def clear_codes(df: DataFrame, codes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Text codes that mean "not available" become null."""
    return df.withColumns({
        c: F.when(F.col(c).isin(list(v)), None).otherwise(F.col(c))
        for c, v in codes.items()
        if c in df.columns and v
    })


def clear_numeric_codes(df: DataFrame, codes: Mapping[str, float]) -> DataFrame:
    """Numeric codes that mean "not available" become null."""
    return df.withColumns({
        c: F.nullif(F.col(c), F.lit(v)) for c, v in codes.items() if c in df.columns
    })


def clear_tokens(df: DataFrame, tokens: Sequence[str] = tuple(schema.NULL_TOKENS)) -> DataFrame:
    """Null spellings of the inferring reader become null in every text column."""
    text = [f for f, t in df.dtypes if t == "string"]
    return clear_codes(df, {c: list(tokens) for c in text})


def number(c: Column | str) -> Column:
    """Double, or null where the text is not a number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def cast_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def month_date(c: Column | str) -> Column:
    """YYYYMM as text or number -> first day of the month, null if not a month."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.try_to_date(F.substring(text, 1, 6), "yyyyMM")


def parse_months(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({
        c: month_date(c) for c in columns if c in types and types[c] != "date"
    })


def pad_postal(c: Column | str) -> Column:
    """Zero-padded to five characters; longer text and null are kept."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def join_key(c: Column | str) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def sale_proceeds(c: Column | str) -> Column:
    """Amount, or null for the unknown code."""
    return number(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("U")))


def month_number(c: Column | str) -> Column:
    """Months since year 0 of a YYYYMM number."""
    value = (F.col(c) if isinstance(c, str) else c).cast("int")
    return F.floor(value / 100).cast("int") * 12 + value % 100


def months_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole months between two YYYYMM numbers."""
    return month_number(later) - month_number(earlier)


def fallback(*values: Column) -> Column:
    """First value that is neither null nor zero; the last one is taken as it is."""
    *tries, last = values
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in tries], last)


def loan_id_vintage(c: Column | str = schema.LOAN) -> Column:
    """Two vintage characters of the loan id."""
    return F.substring(c, 3, 2)


def first_payment_year(c: Column | str) -> Column:
    return F.substring((F.col(c) if isinstance(c, str) else c).cast("string"), 1, 4)
