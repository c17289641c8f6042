"""Bins of numeric columns, all in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.scale import attach, quantiles


def labelled_cut(value: Column, edges: Sequence[float], labels: Sequence[str], right: bool) -> Column:
    """Label of the interval that holds `value`; (a, b] if `right`, else [a, b). Null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (
            (value > low) & (value <= high) if right else (value >= low) & (value < high)
        )
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def quantile_edges(
    df: DataFrame, value: str, q: int = 10, by: Sequence[str] = (), name: str = "_edges",
    frequency: str | None = None,
) -> DataFrame:
    """One row per group with the q + 1 quantile edges."""
    return quantiles(df, value, [i / q for i in range(q + 1)], by, name, frequency=frequency)


def edge_bin(value: Column, edges: Column, q: int) -> Column:
    """1-based bin among the distinct edges: right-closed, lowest value included."""
    below = [(edges[0] < value).cast("int")]
    below += [
        ((edges[i] < value) & (edges[i] != edges[i - 1])).cast("int") for i in range(1, q + 1)
    ]
    return F.greatest(F.lit(1), sum(below[1:], below[0]))


def quantile_bins(
    df: DataFrame, value: str, q: int = 10, by: Sequence[str] = (), name: str = "bin",
    frequency: str | None = None,
) -> DataFrame:
    """Add the quantile bin of `value`; tied edges collapse, null values get no bin."""
    edges = quantile_edges(df, value, q, by, frequency=frequency)
    binned = attach(df, edges, by)
    bin_number = edge_bin(F.col(value), F.col("_edges"), q)
    return binned.withColumn(name, F.when(F.col(value).isNotNull(), bin_number)).drop("_edges")


def reference_bin(value: Column, edges: Column, q: int) -> Column:
    """0-based bin [a, b) with open ends; tied edges leave empty bins."""
    inner = [(edges[i] <= value).cast("int") for i in range(1, q)]
    return sum(inner[1:], inner[0])


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Count per equal-width bin between min and max, last bin closed."""
    kept = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    limits = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    number = F.least(
        F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))) + 1,
        F.lit(bins),
    )
    return (
        attach(kept, limits)
        .groupBy(number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("bin_min"), F.max("v").alias("bin_max"))
    )
