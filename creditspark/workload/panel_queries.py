"""Joins, summaries and loan windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning
from creditspark.functions.binning import equal_width_histogram
from creditspark.models.preprocessing import encode_levels
from creditspark.operators import history, joins, sketches, summaries, transitions
from creditspark.plans import loans
from creditspark.scale import scratch_dir
from creditspark.sources import write_buckets
from creditspark.workload import tables as t
from creditspark.workload.cleaning_queries import ID, LOAN_MONTH, SPLIT
from creditspark.workload.registry import query

LTV_CASE = """CASE WHEN original_ltv > 0 AND original_ltv <= 60 THEN '<=60' WHEN original_ltv > 60 AND original_ltv <= 70 THEN '60-70'
  WHEN original_ltv > 70 AND original_ltv <= 80 THEN '70-80' WHEN original_ltv > 80 AND original_ltv <= 90 THEN '80-90'
  WHEN original_ltv > 90 AND original_ltv <= 100 THEN '90-100' WHEN original_ltv > 100 AND original_ltv <= 200 THEN '>100' END"""
SCORE_CASE = """CASE WHEN credit_score >= 300 AND credit_score < 620 THEN '[300,620)' WHEN credit_score >= 620 AND credit_score < 660 THEN '[620,660)'
  WHEN credit_score >= 660 AND credit_score < 700 THEN '[660,700)' WHEN credit_score >= 700 AND credit_score < 740 THEN '[700,740)'
  WHEN credit_score >= 740 AND credit_score < 780 THEN '[740,780)' WHEN credit_score >= 780 AND credit_score < 850 THEN '[780,850)'
  WHEN credit_score >= 850 AND credit_score < 9999 THEN '[850,9999)' END"""


# --- joins ------------------------------------------------------------------


@query("build_panel", f"""
SELECT {LOAN_MONTH}, current_actual_upb, credit_score, original_upb, loan_purpose, vintage_year FROM panel""")
def _(spark, sf):
    return t.panel(spark, sf).select(
        *ID, "current_actual_upb", "credit_score", "original_upb", "loan_purpose", "vintage_year")


@query("panel_right_join", """
SELECT o.loan_sequence_number, CAST(p.monthly_reporting_period AS VARCHAR) AS monthly_reporting_period,
  o.credit_score, p.current_actual_upb, p.dpd, p.default_flag_quick
FROM orig o LEFT JOIN quick p ON o.loan_sequence_number = p.loan_sequence_number""")
def _(spark, sf):
    panel = joins.panel_of_all_loans(t.quick(spark, sf), t.origination(spark, sf))
    return panel.select(*ID, "credit_score", "current_actual_upb", "dpd", "default_flag_quick")


@query("macro_join", f"""
SELECT {LOAN_MONTH.replace('monthly_reporting_period', 'p.monthly_reporting_period').replace('AS p.', 'AS ')}, m.hpi, m.unemployment_rate, m.fed_funds_rate, m.gdp_real
FROM perf p LEFT JOIN macro_monthly m ON p.monthly_reporting_period = m.date""")
def _(spark, sf):
    joined = joins.with_macro(t.performance(spark, sf), t.macro_table(spark, sf))
    return joined.select(*ID, "hpi", "unemployment_rate", "fed_funds_rate", "gdp_real")


@query("loan_ever_default_join", """
SELECT o.loan_sequence_number, original_ltv, is_default FROM orig o JOIN (
  SELECT loan_sequence_number, max(CAST(evento_default AS INTEGER)) AS is_default FROM staged_rows GROUP BY 1) f
  ON o.loan_sequence_number = f.loan_sequence_number""")
def _(spark, sf):
    flags = joins.loan_flag(t.staged(spark, sf), "evento_default", "is_default")
    return joins.loans_with_flag(t.origination(spark, sf), flags).select(
        "loan_sequence_number", "original_ltv", "is_default")


@query("vintage_left_join", """
SELECT o.loan_sequence_number, substr(CAST(first_payment_date AS VARCHAR), 1, 4) AS vintage, ever_default
FROM orig o LEFT JOIN (
  SELECT loan_sequence_number, max(default_flag_quick) AS ever_default FROM quick GROUP BY 1) f
  ON o.loan_sequence_number = f.loan_sequence_number""")
def _(spark, sf):
    flags = joins.loan_flag(t.quick(spark, sf), "default_flag_quick", "ever_default")
    return joins.loans_with_flag(t.origination(spark, sf), flags, keep_all=True).select(
        "loan_sequence_number", cleaning.first_payment_year("first_payment_date").alias("vintage"),
        "ever_default")


@query("orphan_check", """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN o.loan_sequence_number IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_orphan,
  CAST(sum(CASE WHEN o.credit_score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_probe_null
FROM perf p LEFT JOIN orig o ON p.loan_sequence_number = o.loan_sequence_number""")
def _(spark, sf):
    return joins.orphan_check(t.performance(spark, sf), t.origination(spark, sf))


# --- coverage and rates -----------------------------------------------------


MONTHS = """CAST(min(monthly_reporting_period) AS VARCHAR) AS first_month,
  CAST(max(monthly_reporting_period) AS VARCHAR) AS last_month"""


@query("vintage_coverage", f"""
SELECT vintage_year, {MONTHS}, count(monthly_reporting_period) AS n_obs FROM panel GROUP BY 1""")
def _(spark, sf):
    return summaries.vintage_coverage(t.panel(spark, sf))


@query("panel_stats", f"""
SELECT count(*) AS n_rows, count(DISTINCT loan_sequence_number) AS n_loans, {MONTHS} FROM perf""")
def _(spark, sf):
    return summaries.panel_stats(t.performance(spark, sf))


@query("stage_distribution", """
SELECT ifrs9_stage, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM staged_rows GROUP BY 1""")
def _(spark, sf):
    return summaries.stage_distribution(t.staged(spark, sf))


ACTIVE = "labelled WHERE ifrs9_stage IN (1, 2)"


@query("default_rate_global", f"SELECT avg(default_12m) AS default_rate, count(*) AS n_obs FROM {ACTIVE}")
def _(spark, sf):
    return summaries.default_rate(summaries.active(t.labelled(spark, sf)))


@query("default_rate_by_vintage", f"""
SELECT vintage_year, avg(default_12m) AS default_rate, count(*) AS n_obs FROM {ACTIVE} GROUP BY 1""")
def _(spark, sf):
    return summaries.default_rate(summaries.active(t.labelled(spark, sf)), ["vintage_year"])


@query("default_rate_by_vintage_stage", """
SELECT vintage_year, ifrs9_stage, count(*) AS n_obs, CAST(sum(default_12m) AS BIGINT) AS n_default,
  avg(default_12m) AS default_rate FROM labelled GROUP BY 1, 2""")
def flagship(spark, sf):
    return summaries.default_rate_by_vintage_stage(t.labelled(spark, sf))


@query("split_stats", f"""
SELECT split, count(*) AS n_obs, CAST(sum(default_12m) AS BIGINT) AS n_default, avg(default_12m) AS default_rate
FROM (SELECT *, {SPLIT} AS split FROM {ACTIVE}) WHERE split IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return summaries.split_stats(summaries.active(t.labelled(spark, sf)))


@query("class_ratio", f"""
SELECT CAST(sum(1 - default_12m) AS DOUBLE) / sum(default_12m) AS ratio FROM {ACTIVE}""")
def _(spark, sf):
    return summaries.class_ratio(summaries.active(t.labelled(spark, sf)))


def _describe(source: str, columns: list[str], probs: list[float]) -> str:
    parts = [
        f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c}) AS min, max({c}) AS max, "
        + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(p * 100):02d}" for p in probs)
        + f" FROM {source}" for c in columns
    ]
    return "\nUNION ALL ".join(parts)


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


DESCRIBED = ["credit_score", "original_ltv", "original_dti", "original_upb"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
STATS = ["mean", "std", "p05", "p25", "p50", "p75", "p95"]


@query("describe_origination", _describe("orig", DESCRIBED, PROBS))
def _(spark, sf):
    return _rounded(summaries.describe_columns(t.origination(spark, sf), DESCRIBED, PROBS), *STATS)


@query("describe_performance", f"""
SELECT count(*) AS n_obs, count(DISTINCT loan_sequence_number) AS n_loans, {MONTHS},
  avg(CAST(evento_default AS INTEGER)) AS default_rate,
  avg(CASE WHEN dpd_numerico >= 3 THEN 1 ELSE 0 END) AS rate_90dpd,
  round(avg(current_actual_upb), 6) AS upb_mean, round(stddev_samp(current_actual_upb), 6) AS upb_std,
  min(current_actual_upb) AS upb_min, max(current_actual_upb) AS upb_max,
  {', '.join(f"round(quantile_cont(current_actual_upb, {p}), 6) AS upb_p{round(p * 100)}" for p in PROBS[1:])}
FROM staged_rows""")
def _(spark, sf):
    names = ["upb_mean", "upb_std", "upb_p25", "upb_p50", "upb_p75", "upb_p95"]
    return _rounded(summaries.describe_performance(t.staged(spark, sf)), *names)


WANTED = {
    "credit_score": [0.01, 0.5, 0.99], "original_ltv": [0.05, 0.5, 0.95],
    "original_dti": [0.05, 0.5, 0.95],
}


def _quantile_rows(source: str, wanted: dict) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM {source}"
        for c, probs in wanted.items() for p in probs
    )


@query("quantiles_r", _quantile_rows("orig", WANTED) + "\nUNION ALL "
       + _quantile_rows("perf", {"current_actual_upb": [0.5, 0.95]}))
def _(spark, sf):
    loan_rows = summaries.quantiles_of(t.origination(spark, sf), WANTED)
    months = summaries.quantiles_of(t.performance(spark, sf), {"current_actual_upb": [0.5, 0.95]})
    return _rounded(loan_rows.unionByName(months), "value")


@query("value_ranges", """
SELECT 'first_payment_date' AS variable, CAST(min(first_payment_date) AS VARCHAR) AS lowest,
  CAST(max(first_payment_date) AS VARCHAR) AS highest FROM orig
UNION ALL SELECT 'loan_sequence_number', min(loan_sequence_number), max(loan_sequence_number) FROM orig""")
def _(spark, sf):
    return summaries.value_ranges(t.origination(spark, sf), ["first_payment_date", "loan_sequence_number"])


@query("monthly_performance", """
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period,
  count(DISTINCT loan_sequence_number) AS loans, count(*) AS n_rows,
  avg(CASE WHEN dpd >= 90 THEN 1 WHEN dpd < 90 THEN 0 END) AS share_dpd90,
  avg(default_flag_quick) AS share_default_quick, sum(current_actual_upb) AS upb_sum
FROM quick GROUP BY 1""")
def _(spark, sf):
    return summaries.monthly_performance(t.quick(spark, sf))


@query("monthly_default_dpd", """
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period,
  avg(default_flag_quick) AS share_default, avg(dpd) AS avg_dpd, sum(current_actual_upb) AS tot_balance
FROM quick GROUP BY 1""")
def _(spark, sf):
    return summaries.monthly_default_dpd(t.quick(spark, sf))


@query("default_rate_monthly", """
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period, count(evento_default) AS n,
  CAST(sum(CAST(evento_default AS INTEGER)) AS BIGINT) AS n_default,
  sum(CAST(evento_default AS INTEGER)) * CAST(100 AS DOUBLE) / count(*) AS rate_pct
FROM staged_rows GROUP BY 1""")
def _(spark, sf):
    return summaries.default_rate_monthly(t.staged(spark, sf))


@query("default_rate_vintage_perf", """
SELECT vintage_year, avg(CAST(evento_default AS INTEGER)) AS default_rate, count(*) AS n_obs
FROM (SELECT s.evento_default, p.vintage_year FROM staged_rows s JOIN perf p
  ON s.loan_sequence_number = p.loan_sequence_number AND s.monthly_reporting_period = p.monthly_reporting_period)
WHERE vintage_year IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    df = t.staged(spark, sf).filter(F.col("vintage_year").isNotNull())
    return summaries.default_rate(
        df.withColumn("_e", F.col("evento_default").cast("int")), ["vintage_year"], "_e")


@query("ever_default_by_vintage", """
SELECT substr(CAST(first_payment_date AS VARCHAR), 1, 4) AS vintage, avg(ever_default) AS default_rate, count(*) AS n_loans
FROM orig o LEFT JOIN (
  SELECT loan_sequence_number, max(default_flag_quick) AS ever_default FROM quick GROUP BY 1) f
  ON o.loan_sequence_number = f.loan_sequence_number GROUP BY 1""")
def _(spark, sf):
    flags = joins.loan_flag(t.quick(spark, sf), "default_flag_quick", "ever_default")
    rows = joins.loans_with_flag(t.origination(spark, sf), flags, keep_all=True)
    return summaries.ever_default_by_vintage(rows, cleaning.first_payment_year("first_payment_date"))


@query("default_by_ltv_bucket", f"""
SELECT ltv_bucket, avg(is_default) * 100 AS default_pct, count(*) AS n FROM (
  SELECT {LTV_CASE} AS ltv_bucket, is_default FROM orig o JOIN (
    SELECT loan_sequence_number, max(CAST(evento_default AS INTEGER)) AS is_default FROM staged_rows GROUP BY 1) f
    ON o.loan_sequence_number = f.loan_sequence_number)
WHERE ltv_bucket IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    flags = joins.loan_flag(t.staged(spark, sf), "evento_default", "is_default")
    return summaries.default_by_ltv_bucket(joins.loans_with_flag(t.origination(spark, sf), flags))


@query("default_by_score_bucket", f"""
SELECT {SCORE_CASE} AS score_bucket, avg(default_flag_quick) AS rate_default, count(*) AS n
FROM orig o LEFT JOIN quick p ON o.loan_sequence_number = p.loan_sequence_number GROUP BY 1""")
def _(spark, sf):
    return summaries.default_by_score_bucket(
        joins.panel_of_all_loans(t.quick(spark, sf), t.origination(spark, sf)))


MIX = ["loan_purpose", "property_type", "occupancy_status", "channel"]
MIX_SQL = "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS category, count(*) AS n, "
    f"count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER () AS pct FROM orig WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in MIX)


@query("portfolio_mix", MIX_SQL)
def _(spark, sf):
    return summaries.portfolio_mix(t.origination(spark, sf), MIX)


@query("stack_tables", MIX_SQL.replace("count(*) AS n, ", ""))
def _(spark, sf):
    return summaries.portfolio_mix(t.origination(spark, sf), MIX).drop("n")


@query("dpd_histogram", """
SELECT least(dpd_numerico, 12) AS bucket, count(*) AS n FROM staged_rows WHERE dpd_numerico IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return summaries.dpd_histogram(t.staged(spark, sf))


@query("equal_width_histogram", """
SELECT CAST(least(floor((v - lo) * 60 / (hi - lo)) + 1, 60) AS INTEGER) AS bin, count(*) AS n, min(v) AS bin_min, max(v) AS bin_max
FROM (SELECT current_actual_upb / 1000 AS v, min(current_actual_upb / 1000) OVER () AS lo,
    max(current_actual_upb / 1000) OVER () AS hi
  FROM perf WHERE current_actual_upb > 0) GROUP BY 1""")
def _(spark, sf):
    positive = t.performance(spark, sf).filter(F.col("current_actual_upb") > 0)
    return equal_width_histogram(positive.withColumn("_v", F.col("current_actual_upb") / 1000), "_v", 60)


@query("box_stats", """
SELECT dpd, min(current_actual_upb) AS low, max(current_actual_upb) AS high, count(current_actual_upb) AS n,
  round(quantile_cont(current_actual_upb, 0.25), 6) AS p25, round(quantile_cont(current_actual_upb, 0.5), 6) AS p50,
  round(quantile_cont(current_actual_upb, 0.75), 6) AS p75 FROM quick GROUP BY 1""")
def _(spark, sf):
    return _rounded(summaries.box_stats(t.quick(spark, sf)), "p25", "p50", "p75")


DPD_PCT = ", ".join(
    f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*) AS {n}" for n, c in [
        ("pct_0", "dpd_numerico = 0"), ("pct_30", "dpd_numerico = 1"), ("pct_60", "dpd_numerico = 2"),
        ("pct_3plus", "dpd_numerico >= 3")])


@query("dpd_mix_monthly", f"""
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period, {DPD_PCT}, count(*) AS n
FROM staged_rows GROUP BY 1""")
def _(spark, sf):
    return summaries.dpd_mix_monthly(t.staged(spark, sf))


ODR_SQL = f"""
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period, count(*) AS n_obs,
  CAST(sum(default_12m) AS BIGINT) AS n_default, sum(default_12m) * CAST(100 AS DOUBLE) / count(*) AS odr_pct
FROM {ACTIVE} GROUP BY 1"""


@query("odr_monthly", ODR_SQL)
def _(spark, sf):
    return summaries.odr_monthly(t.labelled(spark, sf))


@query("head_tail_months", """
SELECT * FROM (SELECT *, 'head' AS part FROM odr ORDER BY monthly_reporting_period LIMIT 12)
UNION ALL SELECT * FROM (SELECT *, 'tail' AS part FROM odr ORDER BY monthly_reporting_period DESC LIMIT 12)""",
       odr=ODR_SQL)
def _(spark, sf):
    return summaries.head_tail_months(summaries.odr_monthly(t.labelled(spark, sf)))


BANDS = ", ".join(
    f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in [
        ("band_0", "d = 0"), ("band_1", "d = 1"), ("band_2", "d = 2"), ("band_3plus", "d > 2")])


@query("vintage_dpd_bands", f"""
SELECT vintage_year, {BANDS}, count(*) AS total,
  sum(CASE WHEN d > 2 THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*) AS pct_3plus
FROM (SELECT *, coalesce(dpd_numerico, 0) AS d FROM {ACTIVE}) GROUP BY 1""")
def _(spark, sf):
    return summaries.vintage_dpd_bands(summaries.active(history.default_columns(t.panel(spark, sf))))


@query("vintage_curves", f"""
SELECT vintage_year, loan_age, avg(default_12m) * 100 AS default_rate FROM {ACTIVE} GROUP BY 1, 2""")
def _(spark, sf):
    return summaries.vintage_curves(t.labelled(spark, sf))


@query("dpd_percentiles_monthly", """
SELECT CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period, count(*) AS n,
  round(quantile_cont(dpd_numerico, 0.25), 6) AS p25, round(quantile_cont(dpd_numerico, 0.5), 6) AS p50,
  round(quantile_cont(dpd_numerico, 0.75), 6) AS p75, round(quantile_cont(dpd_numerico, 0.95), 6) AS p95
FROM staged_rows WHERE dpd_numerico > 0 GROUP BY 1""")
def _(spark, sf):
    return _rounded(summaries.dpd_percentiles_monthly(t.staged(spark, sf)), "p25", "p50", "p75", "p95")


REPORTED = [
    "loan_sequence_number", "monthly_reporting_period", "current_actual_upb", "current_loan_delinquency_status", "loan_age",
    "modification_flag", "payment_deferral_flag", "zero_balance_code", "current_interest_rate",
    "estimated_loan_to_value_eltv", "net_sale_proceeds", "credit_score", "first_payment_date", "number_of_units",
    "number_of_borrowers", "original_ltv", "original_cltv", "original_dti", "original_upb", "original_interest_rate",
    "original_loan_term", "occupancy_status", "channel", "loan_purpose", "property_type", "amortization_type",
    "postal_code3_trunc", "vintage_year", "dpd_numerico", "evento_default", "ifrs9_stage",
]


@query("null_report", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
    f"(count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*) AS pct_null FROM staged_rows" for c in REPORTED))
def _(spark, sf):
    return summaries.null_report(history.default_columns(t.panel(spark, sf)))


@query("unique_loans_by_vintage", """
SELECT vintage_year, count(DISTINCT loan_sequence_number) AS n_loans FROM panel GROUP BY 1""")
def _(spark, sf):
    return summaries.unique_loans_by_vintage(t.panel(spark, sf))


@query("sketch_audit", """
SELECT vintage_year, count(*) AS n_rows, count(DISTINCT loan_sequence_number) AS n_distinct, true AS distinct_within, true AS quantile_within
FROM panel GROUP BY 1""")
def _(spark, sf):
    rows = t.panel(spark, sf).select("vintage_year", "loan_sequence_number", "current_actual_upb")
    return sketches.sketch_audit(rows, ["vintage_year"], "loan_sequence_number", "current_actual_upb")


CORRELATED = [
    "credit_score", "original_ltv", "original_cltv", "original_dti", "original_interest_rate",
    "original_loan_term", "original_upb", "number_of_borrowers", "number_of_units", "loan_age",
    "current_interest_rate", "current_actual_upb", "estimated_loan_to_value_eltv", "dpd_numerico",
    "max_dpd_3m", "max_dpd_6m", "max_dpd_12m", "spread_tasa", "amortizacion_upb", "default_12m",
]


@query("feature_correlation", "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM dataset_once"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]), dataset_once="SELECT * FROM dataset")
def _(spark, sf):
    return _rounded(summaries.feature_correlation(t.dataset(spark, sf, with_macro=False), CORRELATED), "corr")


def _by_quantile(name, column):
    @query(name, f"""
SELECT greatest(1, len(list_filter(list_distinct(e), lambda z: z < {column}))) - 1 AS decile,
  avg(default_12m) AS default_rate, count(*) AS n, min({column}) AS value_min, max({column}) AS value_max
FROM (SELECT *, (SELECT quantile_cont({column}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FROM dataset) AS e
  FROM dataset WHERE {column} IS NOT NULL) GROUP BY 1""")
    def _(spark, sf):
        out = summaries.default_by_quantile(summaries.active(t.labelled(spark, sf)), column)
        return out.withColumn("decile", F.col("decile").cast("long"))


_by_quantile("default_by_quantile", "credit_score")
_by_quantile("default_by_quantile_ltv", "original_ltv")


@query("loan_summary", """
SELECT loan_sequence_number, min(vintage_year) AS vintage_year, max(loan_age) AS max_age,
  min(CASE WHEN evento_default THEN loan_age END) AS first_default_age FROM staged_rows GROUP BY 1""")
def _(spark, sf):
    return summaries.loan_summary(history.default_columns(t.panel(spark, sf)))


@query("target_counts", f"SELECT default_12m, count(*) AS n FROM {ACTIVE} GROUP BY 1")
def _(spark, sf):
    return summaries.target_counts(summaries.active(t.labelled(spark, sf)))


@query("scan_overview", """
SELECT 'orig' AS table_name, 18 AS n_columns, count(*) AS n_rows, count(DISTINCT vintage_year) AS n_vintages,
  CAST(NULL AS INTEGER) AS first_month, CAST(NULL AS INTEGER) AS last_month FROM orig_fx
UNION ALL SELECT 'svcg', 12, count(*), count(DISTINCT vintage_year), min(monthly_reporting_period),
  max(monthly_reporting_period) FROM perf_fx""")
def _(spark, sf):
    return summaries.scan_overview(t.raw_origination(spark, sf), "orig").unionByName(
        summaries.scan_overview(t.raw_performance(spark, sf), "svcg", "monthly_reporting_period"))


# --- loan windows -----------------------------------------------------------


@query("lookahead_default", f"SELECT {LOAN_MONTH}, default_12m FROM labelled")
def _(spark, sf):
    return history.lookahead_default(t.staged(spark, sf)).select(*ID, "default_12m")


@query("rolling_max_dpd", f"SELECT {LOAN_MONTH}, max_dpd_3m, max_dpd_6m, max_dpd_12m FROM labelled")
def _(spark, sf):
    return history.rolling_max_dpd(t.staged(spark, sf)).select(
        *ID, "max_dpd_3m", "max_dpd_6m", "max_dpd_12m")


MONTHS = "PARTITION BY loan_sequence_number ORDER BY year(monthly_reporting_period) * 12 + month(monthly_reporting_period) RANGE BETWEEN"


@query("lookahead_default_calendar", f"""
SELECT {LOAN_MONTH}, CAST(coalesce(max(CAST(evento_default AS INTEGER)) OVER ({MONTHS} 1 FOLLOWING AND 12 FOLLOWING), 0) AS INTEGER) AS default_12m
FROM staged_rows""")
def _(spark, sf):
    return history.lookahead_default(t.staged(spark, sf), calendar=True).select(*ID, "default_12m")


@query("lookahead_default_observed", f"""
SELECT {LOAN_MONTH}, default_12m FROM (SELECT *, lead(1, 12) OVER (PARTITION BY loan_sequence_number ORDER BY monthly_reporting_period) AS later FROM labelled)
WHERE later IS NOT NULL""")
def _(spark, sf):
    return history.lookahead_default(t.staged(spark, sf), drop_censored=True).select(*ID, "default_12m")


@query("rolling_max_dpd_calendar", f"""
SELECT {LOAN_MONTH}, max(dpd_numerico) OVER ({MONTHS} 2 PRECEDING AND CURRENT ROW) AS max_dpd_3m,
  max(dpd_numerico) OVER ({MONTHS} 5 PRECEDING AND CURRENT ROW) AS max_dpd_6m,
  max(dpd_numerico) OVER ({MONTHS} 11 PRECEDING AND CURRENT ROW) AS max_dpd_12m FROM staged_rows""")
def _(spark, sf):
    return history.rolling_max_dpd(t.staged(spark, sf), calendar=True).select(
        *ID, "max_dpd_3m", "max_dpd_6m", "max_dpd_12m")


@query("lookahead_default_buckets", f"SELECT {LOAN_MONTH}, default_12m, max_dpd_12m FROM labelled")
def _(spark, sf):
    """The labelled panel from tables stored in buckets of the loan: no exchange after the write."""
    name = uuid.uuid4().hex
    stored = {
        kind: write_buckets(df, f"{kind}_{name}", f"{scratch_dir(spark)}/buckets-{name}/{kind}", buckets=8)
        for kind, df in (("performance", t.performance(spark, sf)), ("origination", t.origination(spark, sf)))}
    panel = loans.labelled_panel(stored["performance"], stored["origination"], rolling=True, trimmed=True)
    return panel.select(*ID, "default_12m", "max_dpd_12m")


def _moved(rows: int) -> str:
    return f"""
SELECT * FROM (SELECT *, lead(ifrs9_stage, {rows}) OVER (PARTITION BY loan_sequence_number
  ORDER BY monthly_reporting_period) AS later FROM staged_rows) WHERE later IS NOT NULL"""


def _matrix(scale: int) -> str:
    cells = ", ".join(
        f"sum(CASE WHEN later = {s} THEN 1 ELSE 0 END) * CAST({scale} AS DOUBLE) / count(*) AS to_{s}" for s in (1, 2, 3))
    return f"SELECT ifrs9_stage, {cells} FROM moved GROUP BY 1"


LONG_MATRIX = """
SELECT ifrs9_stage, later, count(*) AS n,
  CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY ifrs9_stage) AS prob FROM moved GROUP BY 1, 2"""


@query("stage_migration", _matrix(100), moved=_moved(1))
def _(spark, sf):
    matrix = transitions.stage_matrix(history.stage_after(t.staged(spark, sf), 1, "later"), "later", 100.0)
    return transitions.pivot_matrix(matrix, "ifrs9_stage", "later", "prob")


@query("transition_matrix_q", LONG_MATRIX, moved=_moved(3))
def _(spark, sf):
    return transitions.stage_matrix(history.stage_after(t.staged(spark, sf), 3, "later"), "later")


@query("transition_matrix_calendar", LONG_MATRIX, moved=f"""
SELECT * FROM (SELECT *, max(ifrs9_stage) OVER ({MONTHS} 3 FOLLOWING AND 3 FOLLOWING) AS later FROM staged_rows) WHERE later IS NOT NULL""")
def _(spark, sf):
    return transitions.stage_matrix(history.stage_after(t.staged(spark, sf), 3, "later", calendar=True), "later")


@query("pivot_matrix", _matrix(1), moved=_moved(3))
def _(spark, sf):
    matrix = transitions.stage_matrix(history.stage_after(t.staged(spark, sf), 3, "later"), "later")
    return transitions.pivot_matrix(matrix, "ifrs9_stage", "later", "prob")


@query("transition_key_rates", """
SELECT max(CASE WHEN ifrs9_stage = 1 AND later = 3 THEN prob END) AS stage_1_to_3,
  max(CASE WHEN ifrs9_stage = 2 AND later = 1 THEN prob END) AS cure_rate FROM matrix""",
       moved=_moved(3), matrix=LONG_MATRIX)
def _(spark, sf):
    matrix = transitions.stage_matrix(history.stage_after(t.staged(spark, sf), 3, "later"), "later")
    return transitions.key_rates(matrix, "later")


@query("cure_rate_yearly", """
SELECT CAST(year(monthly_reporting_period) AS INTEGER) AS year, avg(CASE WHEN later = 1 THEN 1 ELSE 0 END) AS cure_rate, count(*) AS n
FROM moved WHERE ifrs9_stage = 2 GROUP BY 1""", moved=_moved(3))
def _(spark, sf):
    moved = history.stage_after(t.staged(spark, sf), 3, "later")
    return transitions.cure_rate_yearly(moved, "later", F.year("monthly_reporting_period"))


@query("stage_psi", """
SELECT round(sum((q - p) * ln(q / p)), 9) AS psi, count(*) AS n_stages FROM (
  SELECT greatest(CAST(r AS DOUBLE) / sum(r) OVER (), 1e-6) AS p, greatest(CAST(n AS DOUBLE) / sum(n) OVER (), 1e-6) AS q, r, n
  FROM (SELECT ifrs9_stage, sum(CASE WHEN vintage_year BETWEEN 2016 AND 2020 THEN 1 ELSE 0 END) AS r,
    sum(CASE WHEN vintage_year = 2024 THEN 1 ELSE 0 END) AS n FROM moved GROUP BY 1))
WHERE r > 0 AND n > 0""", moved=_moved(3))
def _(spark, sf):
    panel = history.default_columns(t.panel(spark, sf))
    moved = history.stage_after(
        panel, 3, "later", skew_from=t.performance(spark, sf), parents=t.origination(spark, sf).select(schema.LOAN))
    return transitions.stage_psi(moved).withColumn("psi", F.round("psi", 9))


@query("dedup_check", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (
  SELECT l_partkey, date_trunc('month', l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(spark, sf):
    months = t.table(spark, sf, "lineitem").select(
        "l_partkey", F.date_trunc("month", "l_shipdate").alias("m"))
    return summaries.duplicate_check(months, ["l_partkey", "m"])


@query("union_vintages", "\nUNION ALL ".join(
    f"SELECT loan_sequence_number, vintage_year FROM perf_fx WHERE vintage_year = {y}"
    for y in (2016, 2017, 2018, 2019, 2020, 2022, 2023, 2024)))
def _(spark, sf):
    years = [*schema.TRAIN_VINTAGES, *schema.VALIDATION_VINTAGES, *schema.TEST_VINTAGES]
    rows = t.raw_performance(spark, sf).select("loan_sequence_number", "vintage_year")
    return rows.filter(F.col("vintage_year").isin(years))  # the vintages are partitions of one table: one read


TRANSPOSED = [("count", "count({c})"), ("mean", "round(avg({c}), 6)"), ("min", "min({c})"), ("max", "max({c})")]


@query("transpose_stats", "\nUNION ALL ".join(
    f"SELECT '{s}' AS statistic, " + ", ".join(f"CAST({f.format(c=c)} AS DOUBLE) AS {c}" for c in DESCRIBED)
    + " FROM orig" for s, f in TRANSPOSED))
def _(spark, sf):
    stats = _rounded(summaries.describe_columns(t.origination(spark, sf), DESCRIBED, PROBS), "mean")
    return summaries.transpose_stats(stats, [s for s, _ in TRANSPOSED], "variable", DESCRIBED)


# --- features ---------------------------------------------------------------


FEATURES = [
    "credit_score", "loan_purpose", "property_type", "occupancy_status", "channel", "amortization_type",
    "loan_age", "estimated_loan_to_value_eltv", "dpd_numerico", "max_dpd_3m", "max_dpd_6m", "max_dpd_12m",
    "fue_modificado", "tiene_deferral", "hpi", "unemployment_rate", "fed_funds_rate", "gdp_real",
    "unemployment_yoy_change", "vintage_year", "ifrs9_stage", "default_12m",
]
FRACTIONS = ["spread_tasa", "amortizacion_upb", "mortgage_rate_30y", "hpi_yoy_change"]


@query("feature_dataset", f"""
SELECT {LOAN_MONTH}, {', '.join(FEATURES)}, {', '.join(f'round({c}, 6) AS {c}' for c in FRACTIONS)} FROM dataset""")
def _(spark, sf):
    return _rounded(t.dataset(spark, sf).select(*ID, *FEATURES, *FRACTIONS), *FRACTIONS)


@query("label_encode", """
SELECT loan_sequence_number, """ + ", ".join(
    f"CAST(CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS INTEGER) AS {c}"
    for c in schema.CATEGORICAL) + " FROM orig")
def _(spark, sf):
    return encode_levels(t.origination(spark, sf), schema.CATEGORICAL).select(
        "loan_sequence_number", *schema.CATEGORICAL)
