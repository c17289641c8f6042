"""Macro series to one monthly table.

A series table has columns (series_id, date, value); it is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark import schema


def _month(c: str = "date") -> Column:
    return F.trunc(c, "MM")


def _through_gaps(monthly: DataFrame, hold: bool) -> DataFrame:
    """Each row also covers the months before the next row of its series: with its own
    value if `hold`, else with null.  The last row is one month."""
    w = Window.partitionBy("series_id").orderBy("date")
    last = F.greatest(F.col("date"), F.add_months(F.lead("date").over(w), -1))
    months = F.explode(F.sequence("date", "_last", F.expr("interval 1 month")))
    spread = monthly.withColumn("_last", last).select(
        "series_id", F.col("date").alias("_from"), "value", months.alias("date"))
    value = F.col("value") if hold else F.when(F.col("date") == F.col("_from"), F.col("value"))
    return spread.select("series_id", "date", value.alias("value"))


def quarterly_to_monthly(series: DataFrame) -> DataFrame:
    """Each observation holds until the month before the next one."""
    return _through_gaps(series.select("series_id", _month().alias("date"), "value"), hold=True)


def weekly_to_monthly(series: DataFrame) -> DataFrame:
    """Mean of the month's observations."""
    means = series.groupBy("series_id", _month().alias("date")).agg(F.avg("value").alias("value"))
    return _through_gaps(means, hold=False)


def monthly_last(series: DataFrame) -> DataFrame:
    """Last known observation of the month."""
    known = F.when(F.col("value").isNotNull(), F.col("date"))
    latest = series.groupBy("series_id", _month().alias("date")).agg(
        F.max_by("value", known).alias("value")
    )
    return _through_gaps(latest, hold=False)


def outer_align(monthly: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row per date that any series has, one column per series."""
    wide = monthly.groupBy("date").pivot("series_id", list(names)).agg(F.first("value"))
    return wide.withColumnsRenamed(dict(names))


def year_on_year(
    monthly: DataFrame, percent: Mapping[str, str], difference: Mapping[str, str], rows: int = 12,
) -> DataFrame:
    """Change against the value `rows` rows earlier.

    Percent changes carry the last known value over gaps first; differences do not.
    The table has one row per calendar month, so one window over it is small.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = monthly.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(upto) for c in percent})
    changes = {
        new: (F.try_divide(F.col(f"_f_{c}"), F.lag(f"_f_{c}", rows).over(w)) - 1) * 100
        for c, new in percent.items()
    } | {new: F.col(c) - F.lag(c, rows).over(w) for c, new in difference.items()}
    return filled.withColumns(changes).drop(*[f"_f_{c}" for c in percent])


def macro_monthly(
    series: DataFrame, names: Mapping[str, str] = schema.MACRO_SERIES,
    quarterly: Sequence[str] = tuple(schema.QUARTERLY_SERIES),
    weekly: Sequence[str] = tuple(schema.WEEKLY_SERIES),
) -> DataFrame:
    """All series on the union of their months, with the year-on-year columns."""
    series_id = F.col("series_id")
    wanted = series.filter(series_id.isin(list(names)))
    is_quarterly, is_weekly = series_id.isin(list(quarterly)), series_id.isin(list(weekly))
    monthly = (
        quarterly_to_monthly(wanted.filter(is_quarterly))
        .unionByName(weekly_to_monthly(wanted.filter(is_weekly)))
        .unionByName(monthly_last(wanted.filter(~is_quarterly & ~is_weekly)))
    )
    aligned = outer_align(monthly, names)
    return year_on_year(
        aligned, {"hpi": "hpi_yoy_change"}, {"unemployment_rate": "unemployment_yoy_change"}
    )
