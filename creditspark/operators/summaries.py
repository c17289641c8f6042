"""Descriptive tables of the loan panel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import delinquency
from creditspark.functions.binning import labelled_cut, quantile_bins
from creditspark.functions.delinquency import DPD_BUCKETS
from creditspark.scale import quantiles


def rows() -> Column:
    return F.count(F.lit(1))


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(condition.cast("int"))


def active(df: DataFrame, stage: str = "ifrs9_stage") -> DataFrame:
    """Rows not in default."""
    return df.filter(F.col(stage).isin(1, 2))


# --- coverage ---------------------------------------------------------------


def vintage_coverage(df: DataFrame, month: str = schema.MONTH) -> DataFrame:
    return df.groupBy(schema.VINTAGE).agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        F.count(month).alias("n_obs"),
    )


def panel_stats(
    df: DataFrame, key: str = schema.LOAN, month: str = schema.MONTH, approx: bool = False,
) -> DataFrame:
    loans = F.approx_count_distinct(key) if approx else F.count_distinct(F.col(key))
    return df.agg(
        rows().alias("n_rows"), loans.alias("n_loans"),
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
    )


def scan_overview(df: DataFrame, name: str, month: str | None = None) -> DataFrame:
    """Rows, columns, vintages and month range of a base table."""
    nothing = F.lit(None).cast("int")
    return df.agg(
        rows().alias("n_rows"), F.count_distinct(schema.VINTAGE).alias("n_vintages"),
        (F.min(month) if month else nothing).alias("first_month"),
        (F.max(month) if month else nothing).alias("last_month"),
    ).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "*")


def unique_loans_by_vintage(df: DataFrame, key: str = schema.LOAN) -> DataFrame:
    return df.groupBy(schema.VINTAGE).agg(F.count_distinct(key).alias("n_loans"))


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percent per column, from one aggregate over the table."""
    flags = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]
    counted = df.agg(rows().alias("_n"), *flags)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns
    ]))
    return counted.select("_n", pairs.alias("_p")).select(
        "_p.column_name", "_p.n_null", (F.col("_p.n_null") * 100.0 / F.col("_n")).alias("pct_null")
    )


def duplicate_check(df: DataFrame, keys: Sequence[str] = (schema.LOAN, schema.MONTH)) -> DataFrame:
    """Rows beyond the first of each key."""
    groups = df.groupBy(*keys).agg(rows().alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated"))


# --- shares and rates -------------------------------------------------------


def with_share(counts: DataFrame, n: str, name: str, within: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Share of each row in the total of its group; the input is an aggregated table."""
    total = F.sum(n).over(Window.partitionBy(*within))
    return counts.withColumn(name, F.col(n) * F.lit(scale) / total)


def stage_distribution(df: DataFrame, stage: str = "ifrs9_stage") -> DataFrame:
    return with_share(df.groupBy(stage).agg(rows().alias("n")), "n", "share")


def default_rate(df: DataFrame, by: Sequence[str] = (), target: str = schema.TARGET) -> DataFrame:
    """Target mean and rows per group."""
    return df.groupBy(*by).agg(F.avg(target).alias("default_rate"), F.count(target).alias("n_obs"))


def default_rate_by_vintage_stage(df: DataFrame) -> DataFrame:
    """Observed 12-month default rate by vintage and stage."""
    return df.groupBy(schema.VINTAGE, "ifrs9_stage").agg(
        rows().alias("n_obs"), F.sum(schema.TARGET).alias("n_default"),
        F.avg(schema.TARGET).alias("default_rate"),
    )


def min_obs(df: DataFrame, n: str, least: int) -> DataFrame:
    """Groups with at least `least` observations."""
    return df.filter(F.col(n) >= least)


def temporal_split(df: DataFrame) -> DataFrame:
    """Rows of the three out-of-time parts, with the part's name."""
    named = df.withColumn("split", delinquency.split_name(schema.VINTAGE))
    return named.filter(F.col("split").isNotNull())


def split_stats(df: DataFrame, target: str = schema.TARGET) -> DataFrame:
    return temporal_split(df).groupBy("split").agg(
        rows().alias("n_obs"), F.sum(target).alias("n_default"), F.avg(target).alias("default_rate"),
    )


def class_ratio(df: DataFrame, target: str = schema.TARGET) -> DataFrame:
    """Negatives per positive."""
    return df.agg(
        F.try_divide(F.sum(1 - F.col(target)).cast("double"), F.sum(target)).alias("ratio")
    )


def target_counts(df: DataFrame, target: str = schema.TARGET) -> DataFrame:
    return df.groupBy(target).agg(rows().alias("n"))


def default_rate_monthly(df: DataFrame, month: str = schema.MONTH, event: str = "evento_default") -> DataFrame:
    flag = F.col(event).cast("int")
    return df.groupBy(month).agg(F.count(flag).alias("n"), F.sum(flag).alias("n_default")).withColumn(
        "rate_pct", F.col("n_default") * 100.0 / F.col("n")
    )


def odr_monthly(df: DataFrame, month: str = schema.MONTH, target: str = schema.TARGET) -> DataFrame:
    """Observed default rate per month of the rows not in default."""
    return active(df).groupBy(month).agg(
        F.count(target).alias("n_obs"), F.sum(target).alias("n_default")
    ).withColumn("odr_pct", F.col("n_default") * 100.0 / F.col("n_obs"))


def monthly_performance(df: DataFrame, month: str = schema.MONTH, key: str = schema.LOAN) -> DataFrame:
    """Per month loans, rows, shares of 90+ days and default, balance."""
    return df.groupBy(month).agg(
        F.count_distinct(key).alias("loans"), rows().alias("n_rows"),
        share(F.col("dpd") >= 90).alias("share_dpd90"),
        share(F.col("default_flag_quick") == 1).alias("share_default_quick"),
        F.sum("current_actual_upb").alias("upb_sum"),
    )


def monthly_default_dpd(df: DataFrame, month: str = schema.MONTH) -> DataFrame:
    return df.groupBy(month).agg(
        share(F.col("default_flag_quick") == 1).alias("share_default"),
        F.avg("dpd").alias("avg_dpd"), F.sum("current_actual_upb").alias("tot_balance"),
    )


def head_tail_months(monthly: DataFrame, month: str = schema.MONTH, n: int = 12) -> DataFrame:
    """First and last `n` rows of a monthly table."""
    ends = [("head", F.col(month).asc()), ("tail", F.col(month).desc())]
    head, tail = (
        monthly.orderBy(order).limit(n).withColumn("part", F.lit(part)) for part, order in ends
    )
    return head.unionByName(tail)


# --- buckets ----------------------------------------------------------------


# Bucket limits and labels.
LTV_LIMITS = [0, 60, 70, 80, 90, 100, 200]
LTV_LABELS = ["<=60", "60-70", "70-80", "80-90", "90-100", ">100"]
SCORE_LIMITS = [300, 620, 660, 700, 740, 780, 850, 9999]
SCORE_LABELS = [
    "[300,620)", "[620,660)", "[660,700)", "[700,740)", "[740,780)", "[780,850)", "[850,9999)",
]
BAND_LIMITS = [-1, 0, 1, 2, 100]
BAND_LABELS = ["0", "1", "2", "3+"]


def default_by_ltv_bucket(loans: DataFrame, flag: str = "is_default") -> DataFrame:
    """Percent of loans ever in default per LTV bucket, right-closed."""
    bucket = labelled_cut(F.col("original_ltv"), LTV_LIMITS, LTV_LABELS, right=True)
    return (
        loans.withColumn("ltv_bucket", bucket).filter(F.col("ltv_bucket").isNotNull())
        .groupBy("ltv_bucket").agg((F.avg(flag) * 100).alias("default_pct"), rows().alias("n"))
    )


def default_by_score_bucket(panel: DataFrame, flag: str = "default_flag_quick") -> DataFrame:
    """Default share of the panel rows per score bucket, left-closed; null bucket kept."""
    bucket = labelled_cut(F.col("credit_score"), SCORE_LIMITS, SCORE_LABELS, right=False)
    return panel.groupBy(bucket.alias("score_bucket")).agg(
        share(F.col(flag) == 1).alias("rate_default"), rows().alias("n")
    )


def ever_default_by_vintage(loans: DataFrame, year: Column, flag: str = "ever_default") -> DataFrame:
    """Share of loans ever in default per first-payment year."""
    return loans.groupBy(year.alias("vintage")).agg(
        share(F.col(flag) == 1).alias("default_rate"), rows().alias("n_loans")
    )


def portfolio_mix(
    loans: DataFrame,
    columns: Sequence[str] = ("loan_purpose", "property_type", "occupancy_status", "channel"),
) -> DataFrame:
    """Percent of loans per category, all variables in one stacked table."""
    present = [c for c in columns if c in loans.columns]
    long = loans.select(*present).unpivot([], present, "variable", "category")
    counts = long.filter(F.col("category").isNotNull()).groupBy("variable", "category").agg(
        rows().alias("n")
    )
    return with_share(counts, "n", "pct", ["variable"], 100.0)


def dpd_histogram(df: DataFrame, top: int = 12) -> DataFrame:
    """Rows per delinquency bucket, the last one open."""
    known = df.filter(F.col("dpd_numerico").isNotNull())
    return known.groupBy(F.least("dpd_numerico", F.lit(float(top))).alias("bucket")).agg(rows().alias("n"))


def dpd_range(df: DataFrame, low: int = 0, high: int = 450, width: int = 30) -> DataFrame:
    """Rows per `width` days late, strictly between the limits."""
    kept = df.filter((F.col("dpd") > low) & (F.col("dpd") < high))
    return kept.groupBy((F.floor(F.col("dpd") / width) * width).alias("dpd_from")).agg(rows().alias("n"))


def dpd_mix_monthly(df: DataFrame, month: str = schema.MONTH) -> DataFrame:
    """Percent of rows per month and delinquency label; unknown counts in the total."""
    counts = (
        df.groupBy(F.col(month), delinquency.dpd_bucket("dpd_numerico").alias("bucket"))
        .agg(rows().alias("n")).groupBy(month).pivot("bucket", DPD_BUCKETS).agg(F.first("n")).na.fill(0)
    )
    total = sum((F.col(f"`{b}`") for b in DPD_BUCKETS[1:]), F.col(f"`{DPD_BUCKETS[0]}`"))
    names = ["pct_0", "pct_30", "pct_60", "pct_3plus"]
    return counts.select(
        month, *[(F.col(f"`{b}`") * 100.0 / total).alias(n) for b, n in zip(DPD_BUCKETS, names)],
        total.alias("n"),
    )


def vintage_dpd_bands(df: DataFrame) -> DataFrame:
    """Rows per vintage and delinquency band, total and percent in the worst band."""
    band = labelled_cut(
        F.coalesce("dpd_numerico", F.lit(0.0)), BAND_LIMITS, BAND_LABELS, right=True
    )
    names = ["band_0", "band_1", "band_2", "band_3plus"]
    counts = (
        df.groupBy(F.col(schema.VINTAGE), band.alias("band")).agg(rows().alias("n"))
        .groupBy(schema.VINTAGE).pivot("band", BAND_LABELS).agg(F.first("n")).na.fill(0, BAND_LABELS)
        .withColumnsRenamed(dict(zip(BAND_LABELS, names)))
    )
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return counts.withColumn("total", total).withColumn(
        "pct_3plus", F.try_divide(F.col("band_3plus") * 100.0, F.col("total"))
    )


def vintage_curves(df: DataFrame, target: str = schema.TARGET) -> DataFrame:
    """Percent of defaults by vintage and loan age, rows not in default."""
    return active(df).groupBy(schema.VINTAGE, "loan_age").agg(
        (F.avg(target) * 100).alias("default_rate")
    )


def default_by_quantile(df: DataFrame, value: str, target: str = schema.TARGET, q: int = 10) -> DataFrame:
    """Rate, rows, smallest and largest value per quantile bin (0-based, null values dropped)."""
    kept = df.select(value, target).filter(F.col(value).isNotNull())
    return quantile_bins(kept, value, q).groupBy((F.col("bin") - 1).alias("decile")).agg(
        F.avg(target).alias("default_rate"), F.count(value).alias("n"),
        F.min(value).alias("value_min"), F.max(value).alias("value_max"),
    )


# --- distributions ----------------------------------------------------------


def quantile_columns(df: DataFrame, probs: Sequence[float], array: str = "q", prefix: str = "p") -> DataFrame:
    """The quantile array as one column per probability."""
    names = [f"{prefix}{round(p * 100):02d}" for p in probs]
    return df.select("*", *[F.col(array)[i].alias(n) for i, n in enumerate(names)]).drop(array)


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value) rows of numeric columns."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "variable", "value")


def describe_columns(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95),
    approx: bool = False,
) -> DataFrame:
    """Count, mean, sample deviation, min, quantiles and max per column."""
    stats = [
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    long = long_form(df, columns)
    return quantile_columns(
        quantiles(long, "value", probs, ["variable"], aggs=stats, approx=approx), probs
    )


def transpose_stats(stats: DataFrame, values: Sequence[str], row: str, variables: Sequence[str]) -> DataFrame:
    """Turn a (row, stat...) table into one row per statistic and one column per row value."""
    numbers = stats.select(row, *[F.col(v).cast("double").alias(v) for v in values])
    long = numbers.unpivot([row], list(values), "statistic", "value")
    return long.groupBy("statistic").pivot(row, list(variables)).agg(F.first("value"))


def describe_performance(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, loans, month range, default and 90+ shares, balance quantiles."""
    aggs = [
        rows().alias("n_obs"), F.count_distinct(schema.LOAN).alias("n_loans"),
        F.min(schema.MONTH).alias("first_month"), F.max(schema.MONTH).alias("last_month"),
        F.avg(F.col("evento_default").cast("int")).alias("default_rate"),
        F.avg(F.coalesce(F.col("dpd_numerico") >= 3, F.lit(False)).cast("int")).alias("rate_90dpd"),
        F.avg("current_actual_upb").alias("upb_mean"),
        F.stddev_samp("current_actual_upb").alias("upb_std"),
        F.min("current_actual_upb").alias("upb_min"), F.max("current_actual_upb").alias("upb_max"),
    ]
    probs = [0.25, 0.5, 0.75, 0.95]
    return quantile_columns(
        quantiles(df, "current_actual_upb", probs, aggs=aggs, approx=approx), probs, prefix="upb_p"
    )


def quantiles_of(df: DataFrame, wanted: dict[str, Sequence[float]], approx: bool = False) -> DataFrame:
    """(variable, p, value) rows for chosen quantiles of each column."""
    every = sorted({p for probs in wanted.values() for p in probs})
    table = quantiles(long_form(df, list(wanted)), "value", every, ["variable"], approx=approx)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in every]).alias("p"), F.col("q").alias("value")))
    rows_ = table.select("variable", pairs.alias("_x")).select("variable", "_x.p", "_x.value")
    keep = F.lit(False)
    for variable, probs in wanted.items():
        keep = keep | ((F.col("variable") == variable) & F.col("p").isin([float(p) for p in probs]))
    return rows_.filter(keep)


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest known value per column."""
    ends = df.agg(*[
        F.struct(F.min(c).cast("string").alias("lowest"), F.max(c).cast("string").alias("highest")).alias(c)
        for c in columns
    ])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c)["lowest"].alias("lowest"), F.col(c)["highest"].alias("highest"))
        for c in columns
    ]))
    return ends.select(pairs.alias("_x")).select("_x.*")


def box_stats(df: DataFrame, value: str = "current_actual_upb", by: str = "dpd", approx: bool = False) -> DataFrame:
    """Quartiles of a value per group."""
    probs = [0.25, 0.5, 0.75]
    aggs = [F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")]
    return quantile_columns(quantiles(df, value, probs, [by], aggs=aggs, approx=approx), probs)


def dpd_percentiles_monthly(df: DataFrame, month: str = schema.MONTH, approx: bool = False) -> DataFrame:
    """Quantiles of positive delinquency per month."""
    probs = [0.25, 0.5, 0.75, 0.95]
    late = df.filter(F.col("dpd_numerico") > 0)
    aggs = [F.count("dpd_numerico").alias("n")]
    return quantile_columns(
        quantiles(late, "dpd_numerico", probs, [month], aggs=aggs, approx=approx), probs
    )


PAIR_SUMS = "feature_a string, feature_b string, n double, ma double, mb double, saa double, sbb double, sab double"


def feature_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are known.

    Each task reduces its rows to one set of pair sums (counts, means, centred
    products) with a few matrix products; only those sums are shuffled.
    """
    names = list(columns)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names)
        total, centre = np.zeros((6, size, size)), None
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            known = ~np.isnan(x)
            if centre is None:
                seen = known.sum(axis=0)
                centre = np.where(seen > 0, np.nansum(x, axis=0) / np.maximum(seen, 1), 0.0)
            m = known.astype(float)
            x = np.where(known, x - centre, 0.0)
            a, aa = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, a, a.T, aa, aa.T, x.T @ x])
        if centre is None:
            return
        i, j = np.triu_indices(size, 1)
        n, a, b, aa, bb, ab = (t[i, j] for t in total)
        kept = n > 0
        i, j, n, a, b, aa, bb, ab = (v[kept] for v in (i, j, n, a, b, aa, bb, ab))
        yield pd.DataFrame({
            "feature_a": [names[k] for k in i], "feature_b": [names[k] for k in j], "n": n,
            "ma": centre[i] + a / n, "mb": centre[j] + b / n,
            "saa": aa - a * a / n, "sbb": bb - b * b / n, "sab": ab - a * b / n,
        })

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(reduce_rows, PAIR_SUMS)
    n, ma, mb = F.col("n"), F.col("ma"), F.col("mb")
    total_n = F.sum(n)

    def merged(within: str, u: Column, v: Column) -> Column:
        return F.sum(F.col(within) + n * u * v) - F.sum(n * u) * F.sum(n * v) / total_n

    sums = parts.groupBy("feature_a", "feature_b").agg(
        merged("saa", ma, ma).alias("saa"), merged("sbb", mb, mb).alias("sbb"),
        merged("sab", ma, mb).alias("sab"),
    )
    spread = F.sqrt(F.greatest(F.col("saa"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("sbb"), F.lit(0.0)))
    return sums.select("feature_a", "feature_b", F.try_divide(F.col("sab"), spread).alias("corr"))


# --- per loan ---------------------------------------------------------------


def loan_summary(df: DataFrame, key: str = schema.LOAN) -> DataFrame:
    """Per loan vintage, largest age and age at the first default, in one aggregate."""
    return df.groupBy(key).agg(
        F.min(schema.VINTAGE).alias(schema.VINTAGE), F.max("loan_age").alias("max_age"),
        F.min(F.when(F.col("evento_default"), F.col("loan_age"))).alias("first_default_age"),
    )
