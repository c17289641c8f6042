"""Macro scenarios: shocked rows, scenario probabilities and their weighted mean."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions.features import clip
from creditspark.operators.curves import cumulative_pd, marginal_pd_by_age

MAX_AGE = 360

Scenarios = Mapping[str, tuple[float, float, float, float]]


def scenario_shock(df: DataFrame, scenarios: Scenarios = schema.SCENARIOS) -> DataFrame:
    """Every row once per scenario with its macro columns shocked.

    The scenarios are literals exploded beside the row, so nothing is joined or shuffled.
    """
    options = F.array(*[
        F.struct(
            F.lit(name).alias("scenario"), F.lit(float(weight)).alias("weight"),
            F.lit(float(hpi)).alias("_hpi"), F.lit(float(unemployment)).alias("_un"),
            F.lit(float(funds)).alias("_ff"),
        )
        for name, (weight, hpi, unemployment, funds) in scenarios.items()
    ])
    rows = df.select("*", F.inline(options))
    shocked = {
        "hpi": F.col("hpi") * F.col("_hpi"),
        "hpi_yoy_change": F.col("hpi_yoy_change") + (F.col("_hpi") - 1) * 100,
        "unemployment_rate": clip(F.col("unemployment_rate") + F.col("_un"), low=0.0),
        "unemployment_yoy_change": F.col("unemployment_yoy_change") + F.col("_un"),
        "fed_funds_rate": clip(F.col("fed_funds_rate") + F.col("_ff"), low=0.0),
    }
    present = {c: v for c, v in shocked.items() if c in df.columns}
    return rows.withColumns(present).drop("_hpi", "_un", "_ff")


def scenario_pd(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], pd: str = "pd",
    scenarios: Scenarios = schema.SCENARIOS, least: int = 50,
) -> DataFrame:
    """Mean 12-month and largest lifetime probability per scenario.

    `score` adds the column `pd`; all scenarios are scored in one pass and reduced to
    one row per scenario and age before anything else.
    """
    scored = score(scenario_shock(df, scenarios))
    by = ["scenario", "weight"]
    per_age = scored.groupBy(*by, "loan_age").agg(
        F.sum(pd).alias("_sum"), F.count(pd).alias("n_obs"), F.avg(pd).alias("pd_marginal")
    )
    counted = (F.col("n_obs") >= least) & (F.col("loan_age") <= MAX_AGE)
    survival = F.product(F.when(counted, 1 - F.col("pd_marginal")))
    upto = (
        Window.partitionBy("scenario").orderBy("loan_age")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    curve = per_age.withColumn("pd_lifetime", F.when(counted, 1 - survival.over(upto)))
    return curve.groupBy(*by).agg(
        F.round(F.sum("_sum") / F.sum("n_obs"), 6).alias("pd_mean_12m"),
        F.round(F.max("pd_lifetime"), 6).alias("pd_lifetime_max"),
    )


def scenario_curves(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], pd: str = "pd",
    scenarios: Scenarios = schema.SCENARIOS, least: int = 50,
) -> DataFrame:
    """Lifetime curve per scenario."""
    scored = score(scenario_shock(df, scenarios))
    return cumulative_pd(marginal_pd_by_age(scored, pd, ["scenario"], least), ["scenario"], name="pd_lifetime")


def weighted_pd(results: DataFrame) -> DataFrame:
    """Sum of weight x mean probability (no loss or exposure in it)."""
    return results.agg(F.sum(F.col("weight") * F.col("pd_mean_12m")).alias("weighted_pd"))
