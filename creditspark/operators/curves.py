"""Lifetime default curves and their backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.operators.summaries import loan_summary, min_obs, rows

HORIZONS = (12, 24, 36, 48, 60)
REFERENCE_AGES = (12, 24, 36, 60, 120, 240)


def marginal_pd_by_age(
    scored: DataFrame, pd: str, by: Sequence[str] = (), least: int = 100,
) -> DataFrame:
    """Mean score per loan age, for ages with enough rows."""
    per_age = scored.groupBy(*by, "loan_age").agg(F.avg(pd).alias("pd_marginal"), F.count(pd).alias("n_obs"))
    return min_obs(per_age, "n_obs", least)


def cumulative_pd(
    curve: DataFrame, by: Sequence[str] = (), max_age: int = 360, name: str = "pd_lifetime_acum",
) -> DataFrame:
    """1 - product of (1 - marginal) in age order.

    The scores are 12-month probabilities, so neighbouring ages overlap; the product
    is kept as defined.  A curve has one row per age, so its window is small.
    """
    upto = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("loan_age")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = curve.filter(F.col("loan_age") <= max_age)
    return kept.withColumn(name, 1 - F.product(1 - F.col("pd_marginal")).over(upto))


def curve_asof(
    curve: DataFrame, horizons: Sequence[int] = HORIZONS, value: str = "pd_lifetime_acum",
) -> DataFrame:
    """Curve value at the last age not above each horizon (null before the first age)."""
    age = F.col("loan_age")
    found = curve.agg(*[
        F.max_by(value, F.when(age <= h, age)).alias(f"h{h}") for h in horizons
    ])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon_months"), F.col(f"h{h}").alias("pred_lifetime_pd"))
        for h in horizons
    ]))
    return found.select(pairs.alias("_x")).select("_x.*")


def reference_points(curve: DataFrame, ages: Sequence[int] = REFERENCE_AGES) -> DataFrame:
    return curve.filter(F.col("loan_age").isin([float(a) for a in ages]))


def observed_lifetime(
    panel: DataFrame, horizons: Sequence[int] = HORIZONS, least: int = 100,
) -> DataFrame:
    """Share of loans in default by each horizon among loans seen that long.

    One aggregate per loan, one per vintage; the horizons are conditions, not copies.
    """
    loans = loan_summary(panel)

    def seen(h: int) -> Column:
        return F.col("max_age") >= h

    wide = loans.groupBy(schema.VINTAGE).agg(
        *[F.count_if(seen(h)).alias(f"n{h}") for h in horizons],
        *[F.count_if(seen(h) & (F.col("first_default_age") <= h)).alias(f"d{h}") for h in horizons],
    )
    pairs = F.explode(F.array(*[
        F.struct(
            F.lit(h).alias("horizon_months"), F.col(f"n{h}").alias("n_loans"), F.col(f"d{h}").alias("_d")
        )
        for h in horizons
    ]))
    long = wide.select(schema.VINTAGE, pairs.alias("_x")).select(schema.VINTAGE, "_x.*")
    return min_obs(long, "n_loans", least).select(
        schema.VINTAGE, "horizon_months", (F.col("_d") / F.col("n_loans")).alias("obs_default_rate"),
        "n_loans",
    )


def lifetime_backtest(
    panel: DataFrame, curve: DataFrame, horizons: Sequence[int] = HORIZONS, least: int = 100,
) -> DataFrame:
    """Observed against predicted lifetime default per vintage and horizon.

    Only loans seen up to the horizon count, so loans that left earlier by default
    are not in it; kept as defined.
    """
    predicted = curve_asof(curve, horizons)
    observed = observed_lifetime(panel, horizons, least)
    both = observed.join(F.broadcast(predicted), "horizon_months", "left")
    pred, obs = F.col("pred_lifetime_pd"), F.col("obs_default_rate")
    return both.select(
        schema.VINTAGE, "horizon_months", F.round(obs, 6).alias("obs_default_rate"),
        F.round(pred, 6).alias("pred_lifetime_pd"),
        F.round(F.when(obs > 0, pred / obs), 3).alias("ratio_pred_obs"),
        F.round(F.abs(pred - obs), 6).alias("abs_error"), "n_loans",
    )


def backtest_matrix(backtest: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per vintage: observed rate and error for each horizon (null where too few loans are seen)."""
    at = lambda c, h: F.max(F.when(F.col("horizon_months") == h, F.col(c)))
    return backtest.groupBy(schema.VINTAGE).agg(*[
        at(c, h).alias(f"{n}_{h}") for h in horizons for c, n in (("obs_default_rate", "obs"), ("abs_error", "error"))
    ])


def lifetime_backtest_summary(backtest: DataFrame) -> DataFrame:
    return backtest.agg(
        F.avg("abs_error").alias("mae"), F.avg("ratio_pred_obs").alias("mean_ratio"), rows().alias("n")
    )
