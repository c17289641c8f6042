"""Macro series and lifetime curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.models import scenarios
from creditspark.operators import curves, macro
from creditspark.workload import tables as t
from creditspark.workload.cleaning_queries import SCENARIO_ROWS, SHOCKED_ROWS
from creditspark.workload.registry import query


def _only(spark, sf, *names):
    return t.macro_series(spark, sf).filter(F.col("series_id").isin(*names))


LONG = "SELECT series_id, CAST(date AS VARCHAR) AS date, {value} AS value FROM {source}"


@query("resample_quarterly_ffill", LONG.format(value="value", source="macro_quarterly"))
def _(spark, sf):
    return macro.quarterly_to_monthly(_only(spark, sf, "USSTHPI", "GDPC1"))


@query("resample_weekly_mean", LONG.format(value="round(value, 6)", source="macro_weekly"))
def _(spark, sf):
    return macro.weekly_to_monthly(_only(spark, sf, "MORTGAGE30US")).withColumn("value", F.round("value", 6))


@query("resample_monthly_last", LONG.format(value="value", source="macro_last"))
def _(spark, sf):
    return macro.monthly_last(_only(spark, sf, "UNRATE", "FEDFUNDS"))


@query("outer_align", """
SELECT CAST(date AS VARCHAR) AS date, hpi, unemployment_rate FROM macro_aligned""")
def _(spark, sf):
    parts = macro.quarterly_to_monthly(_only(spark, sf, "USSTHPI")).unionByName(
        macro.monthly_last(_only(spark, sf, "UNRATE", "FEDFUNDS"))).unionByName(
        macro.weekly_to_monthly(_only(spark, sf, "MORTGAGE30US")))
    names = {"USSTHPI": "hpi", "UNRATE": "unemployment_rate"}
    return macro.outer_align(parts, names)


@query("yoy_change", """
SELECT CAST(date AS VARCHAR) AS date, hpi, round(hpi_yoy_change, 6) AS hpi_yoy_change, unemployment_yoy_change
FROM macro_monthly""")
def _(spark, sf):
    return t.macro_table(spark, sf).select(
        "date", "hpi", F.round("hpi_yoy_change", 6).alias("hpi_yoy_change"), "unemployment_yoy_change")


@query("macro_monthly", """
SELECT * REPLACE (CAST(date AS VARCHAR) AS date, round(mortgage_rate_30y, 6) AS mortgage_rate_30y,
  round(hpi_yoy_change, 6) AS hpi_yoy_change) FROM macro_monthly""")
def _(spark, sf):
    df = t.macro_table(spark, sf)
    return df.withColumns({c: F.round(c, 6) for c in ("mortgage_rate_30y", "hpi_yoy_change")})


# --- curves -----------------------------------------------------------------

CURVE = """
SELECT loan_age, pd_marginal, n_obs,
  1 - product(1 - pd_marginal) OVER (ORDER BY loan_age ROWS UNBOUNDED PRECEDING) AS pd_lifetime_acum
FROM (SELECT loan_age, avg(pd_current) AS pd_marginal, count(pd_current) AS n_obs
  FROM scored WHERE ifrs9_stage IN (1, 2) GROUP BY 1 HAVING count(pd_current) >= 100)
WHERE loan_age <= 360"""


def active_scores(spark, sf):
    """Scores and ages of rows in stage 1 or 2; both come from the performance rows, so no loan is joined."""
    return t.with_scores(t.staged(spark, sf)).filter(F.col("ifrs9_stage").isin(1, 2))


def curve(spark, sf):
    active = active_scores(spark, sf)
    return curves.cumulative_pd(curves.marginal_pd_by_age(active, "pd_current"))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("marginal_pd_by_age", "SELECT loan_age, round(pd_marginal, 6) AS pd_marginal, n_obs FROM (" + CURVE + ")")
def _(spark, sf):
    active = active_scores(spark, sf)
    return _rounded(curves.marginal_pd_by_age(active, "pd_current"), "pd_marginal")


@query("cumulative_pd", """
SELECT loan_age, round(pd_marginal, 6) AS pd_marginal, n_obs, round(pd_lifetime_acum, 6) AS pd_lifetime_acum FROM curve""",
       curve=CURVE)
def _(spark, sf):
    return _rounded(curve(spark, sf), "pd_marginal", "pd_lifetime_acum")


ASOF = """
SELECT h AS horizon_months, (SELECT arg_max(pd_lifetime_acum, loan_age) FROM curve WHERE loan_age <= h) AS pred_lifetime_pd
FROM (VALUES (12), (24), (36), (48), (60)) AS v(h)"""


@query("curve_asof", "SELECT horizon_months, round(pred_lifetime_pd, 6) AS pred_lifetime_pd FROM (" + ASOF + ")", curve=CURVE)
def _(spark, sf):
    return _rounded(curves.curve_asof(curve(spark, sf)), "pred_lifetime_pd")


@query("reference_points", """
SELECT loan_age, round(pd_marginal, 6) AS pd_marginal, n_obs, round(pd_lifetime_acum, 6) AS pd_lifetime_acum FROM curve
WHERE loan_age IN (12, 24, 36, 60, 120, 240)""", curve=CURVE)
def _(spark, sf):
    return _rounded(curves.reference_points(curve(spark, sf)), "pd_marginal", "pd_lifetime_acum")


BACKTEST = f"""
SELECT l.vintage_year, h AS horizon_months, count(*) AS n_loans,
  CAST(sum(CASE WHEN first_default_age <= h THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS obs,
  any_value(a.pred_lifetime_pd) AS pred
FROM (SELECT loan_sequence_number, min(vintage_year) AS vintage_year, max(loan_age) AS max_age,
    min(CASE WHEN evento_default THEN loan_age END) AS first_default_age FROM staged_rows GROUP BY 1) l,
  (VALUES (12), (24), (36), (48), (60)) AS v(h), ({ASOF}) a
WHERE max_age >= h AND a.horizon_months = h GROUP BY 1, 2 HAVING count(*) >= 100"""
BACKTEST_ROUNDED = f"""
SELECT vintage_year, horizon_months, round(obs, 6) AS obs_default_rate, round(pred, 6) AS pred_lifetime_pd,
  round(CASE WHEN obs > 0 THEN pred / obs END, 3) AS ratio_pred_obs, round(abs(pred - obs), 6) AS abs_error, n_loans
FROM ({BACKTEST})"""


def backtest(spark, sf):
    return curves.lifetime_backtest(t.labelled(spark, sf), curve(spark, sf))


@query("lifetime_backtest", BACKTEST_ROUNDED, curve=CURVE)
def _(spark, sf):
    return backtest(spark, sf)


@query("lifetime_backtest_summary", f"""
SELECT round(avg(abs_error), 6) AS mae, round(avg(ratio_pred_obs), 6) AS mean_ratio, count(*) AS n FROM ({BACKTEST_ROUNDED})""",
       curve=CURVE)
def _(spark, sf):
    return _rounded(curves.lifetime_backtest_summary(backtest(spark, sf)), "mae", "mean_ratio")


HORIZON_CELLS = ", ".join(
    f"max(CASE WHEN horizon_months = {h} THEN {v} END) AS {n}_{h}" for h in (12, 24, 36, 48, 60)
    for v, n in (("obs_default_rate", "obs"), ("abs_error", "error")))


@query("lifetime_backtest_matrix", f"SELECT vintage_year, {HORIZON_CELLS} FROM ({BACKTEST_ROUNDED}) GROUP BY 1", curve=CURVE)
def _(spark, sf):
    return curves.backtest_matrix(backtest(spark, sf))


# --- scenarios --------------------------------------------------------------

# A given score of the shocked macro columns; any model takes its place.
SCORE_SQL = """(coalesce(dpd_numerico, 0) + 1) * (coalesce(unemployment_rate, 5) + 1) / 4000
  + coalesce(fed_funds_rate, 2) / 1000 - least(coalesce(hpi, 300), 600) / 300000"""


def macro_score(df):
    known = lambda c, v: F.coalesce(F.col(c), F.lit(float(v)))
    dpd = F.coalesce("dpd_numerico", F.lit(0.0))
    return df.withColumn(
        "pd", (dpd + 1) * (known("unemployment_rate", 5) + 1) / 4000 + known("fed_funds_rate", 2) / 1000
        - F.least(known("hpi", 300), F.lit(600.0)) / 300000)


def scenario_rows(spark, sf):
    return t.dataset(spark, sf, encode=False).filter(F.col("vintage_year") == 2024).select(
        "loan_age", "dpd_numerico", "hpi", "hpi_yoy_change", "unemployment_rate", "unemployment_yoy_change",
        "fed_funds_rate")


def scenario_results(spark, sf):
    return scenarios.scenario_pd(scenario_rows(spark, sf), macro_score)


SCENARIO_TABLES = {
    "scenario_rows": SCENARIO_ROWS,
    "shocked_rows": SHOCKED_ROWS,
    "scenario_scored": f"SELECT *, {SCORE_SQL} AS pd FROM shocked_rows",
    "scenario_mean": "SELECT scenario, weight, round(avg(pd), 6) AS pd_mean_12m FROM scenario_scored GROUP BY 1, 2",
    "scenario_curve": """
SELECT scenario, loan_age, 1 - product(1 - m) OVER (PARTITION BY scenario ORDER BY loan_age ROWS UNBOUNDED PRECEDING) AS pd_lifetime
FROM (SELECT scenario, loan_age, avg(pd) AS m FROM scenario_scored GROUP BY 1, 2 HAVING count(pd) >= 50)
WHERE loan_age <= 360""",
}


@query("scenario_mean_pd", "SELECT * FROM scenario_mean", **SCENARIO_TABLES)
def _(spark, sf):
    return scenario_results(spark, sf).drop("pd_lifetime_max")


@query("scenario_pd", """
SELECT m.*, round(c.top, 6) AS pd_lifetime_max FROM scenario_mean m LEFT JOIN (
  SELECT scenario, max(pd_lifetime) AS top FROM scenario_curve GROUP BY 1) c ON m.scenario = c.scenario""",
       **SCENARIO_TABLES)
def _(spark, sf):
    return scenario_results(spark, sf)


@query("weighted_pd", "SELECT round(sum(weight * pd_mean_12m), 6) AS weighted_pd FROM scenario_mean", **SCENARIO_TABLES)
def _(spark, sf):
    return _rounded(scenarios.weighted_pd(scenario_results(spark, sf)), "weighted_pd")


@query("scenario_curves", "SELECT scenario, loan_age, round(pd_lifetime, 6) AS pd_lifetime FROM scenario_curve", **SCENARIO_TABLES)
def _(spark, sf):
    return _rounded(scenarios.scenario_curves(scenario_rows(spark, sf), macro_score).select("scenario", "loan_age", "pd_lifetime"), "pd_lifetime")
