"""Scans, cleaning, scalar rules, filters and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning, delinquency, features
from creditspark.models.scenarios import scenario_shock
from creditspark.operators import joins, sampling, summaries
from creditspark.plans import loan_master, loans
from creditspark.scale import scratch_dir
from creditspark.sources import append_delivery, file_ledger, read_deliveries, read_pipe, read_table
from creditspark.workload import tables as t
from creditspark.workload.registry import query

ID = ["loan_sequence_number", "monthly_reporting_period"]
LOAN_MONTH = "loan_sequence_number, CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period"


@query("scan_pipe", """
SELECT loan_sequence_number, CAST(monthly_reporting_period AS VARCHAR) AS monthly_reporting_period,
  current_loan_delinquency_status, modification_flag, zero_balance_code, net_sale_proceeds,
  CAST(vintage_year AS VARCHAR) AS vintage_year
FROM perf_fx""")
def _(spark, sf):
    names = [*ID, "current_loan_delinquency_status", "modification_flag", "zero_balance_code",
             "net_sale_proceeds", "vintage_year"]
    path = f"{scratch_dir(spark)}/scan-pipe-{uuid.uuid4().hex}"
    rows = t.raw_performance(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in names])
    rows.write.options(sep="|", quote="", nullValue="").csv(path)
    return read_pipe(spark, path, names)


@query("scan_ledger", """
SELECT CAST(vintage_year AS VARCHAR) AS folder, 'read' AS status, count(*) AS rows, 0 AS wrong_rows FROM perf_fx GROUP BY 1""")
def _(spark, sf):
    """The record of one pipe-delimited file per vintage."""
    names = [*ID, "current_loan_delinquency_status", "modification_flag", "zero_balance_code", "net_sale_proceeds"]
    path = f"{scratch_dir(spark)}/scan-ledger-{uuid.uuid4().hex}"
    rows = t.raw_performance(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in names], "vintage_year")
    rows.repartition("vintage_year").write.partitionBy("vintage_year").options(sep="|", quote="", nullValue="").csv(path)
    ledger = file_ledger(spark, f"{path}/*/part-*.csv", names)
    folder = F.regexp_extract("file", r"vintage_year=(\d{4})/", 1)
    return ledger.groupBy(folder.alias("folder"), "status").agg(
        F.sum("rows").alias("rows"), F.sum("wrong_rows").cast("int").alias("wrong_rows"))


@query("append_quarters", """
SELECT CAST(monthly_reporting_period AS VARCHAR) AS period, count(*) AS n, count(DISTINCT loan_sequence_number) AS n_loans
FROM (SELECT loan_sequence_number, monthly_reporting_period // 100 AS monthly_reporting_period FROM perf_fx) GROUP BY 1""")
def _(spark, sf):
    """Two deliveries that share no row, the first of them appended twice, the second late and in two versions."""
    path = f"{scratch_dir(spark)}/quarters-{uuid.uuid4().hex}"
    rows = t.raw_performance(spark, sf).withColumn("period", F.expr("monthly_reporting_period div 100"))
    early = F.col("vintage_year") % 2 == 0
    first, second = rows.where(early), rows.where(early.isNull() | ~early)
    append_delivery(first, path, "first", "period")
    append_delivery(second.where("loan_age < 20"), path, "second", "period")
    append_delivery(first, path, "first", "period")
    append_delivery(second, path, "second", "period")
    return read_deliveries(spark, path, "period").groupBy(F.col("period").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("loan_sequence_number").alias("n_loans"))


@query("scan_parquet_projected", "SELECT l_orderkey, l_partkey, l_shipdate FROM (SELECT l_orderkey, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate FROM lineitem)")
def _(spark, sf):
    wanted = ["l_orderkey", "l_partkey", "l_shipdate", "not_a_column"]
    df = read_table(spark, f"{sf}/lineitem.parquet", wanted)
    return df.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("normalize_columns", """
SELECT loan_sequence_number, monthly_reporting_period, loan_age, vintage_year FROM perf_fx""")
def _(spark, sf):
    raw = t.raw_performance(spark, sf).select(*ID, "loan_age", "vintage_year")
    suffixed = raw.toDF("loan_sequence_number_V1", "monthly_reporting_period_V2", "loan_age_V5", "year")
    return cleaning.normalize_columns(suffixed)


CODED = ["credit_score", "number_of_units", "occupancy_status", "original_cltv", "original_dti",
         "original_ltv", "channel", "property_type", "number_of_borrowers", "loan_purpose"]
NUMBERS = ["credit_score", "number_of_units", "number_of_borrowers", "original_ltv", "original_cltv",
           "original_dti"]


def _as_text(df, columns):
    """Whole numbers as they stand in the text files."""
    types = dict(df.dtypes)
    return df.withColumns({
        c: (F.col(c).cast("long") if types[c] == "double" else F.col(c)).cast("string") for c in columns
    })


@query("clean_sentinels_orig", f"""
SELECT trim(loan_sequence_number) AS loan_sequence_number,
  {', '.join(f"nullif(CAST(CAST({c} AS BIGINT) AS VARCHAR), '{schema.ORIGINATION_CODES[c][0]}') AS {c}" if c in NUMBERS else f"nullif({c}, '{schema.ORIGINATION_CODES[c][0]}') AS {c}" for c in CODED)}
FROM orig_fx""")
def _(spark, sf):
    text = _as_text(t.raw_origination(spark, sf), CODED)
    cleaned = cleaning.clear_codes(text, schema.ORIGINATION_CODES)
    return cleaned.select(cleaning.join_key("loan_sequence_number").alias("loan_sequence_number"), *CODED)


@query("clean_sentinels_perf", """
SELECT loan_sequence_number, monthly_reporting_period,
  nullif(CAST(CAST(estimated_loan_to_value_eltv AS BIGINT) AS VARCHAR), '999') AS estimated_loan_to_value_eltv,
  nullif(net_sale_proceeds, 'U') AS net_sale_proceeds
FROM perf_fx""")
def _(spark, sf):
    text = _as_text(t.raw_performance(spark, sf), ["estimated_loan_to_value_eltv"])
    return cleaning.clear_codes(text, schema.PERFORMANCE_CODES).select(
        *ID, "estimated_loan_to_value_eltv", "net_sale_proceeds")


@query("clean_sentinels_numeric", f"""
SELECT loan_sequence_number, {', '.join(f'nullif({c}, {schema.ORIGINATION_NUMERIC_CODES[c]}) AS {c}' for c in NUMBERS)}
FROM orig_fx""")
def _(spark, sf):
    return cleaning.clear_numeric_codes(
        t.raw_origination(spark, sf), schema.ORIGINATION_NUMERIC_CODES
    ).select("loan_sequence_number", *NUMBERS)


@query("cast_numeric", """
SELECT loan_sequence_number, monthly_reporting_period,
  TRY_CAST(current_loan_delinquency_status AS DOUBLE) AS current_loan_delinquency_status,
  TRY_CAST(net_sale_proceeds AS DOUBLE) AS net_sale_proceeds
FROM perf_fx""")
def _(spark, sf):
    columns = ["current_loan_delinquency_status", "net_sale_proceeds"]
    return cleaning.cast_numeric(t.raw_performance(spark, sf), columns).select(*ID, *columns)


@query("parse_yyyymm", """
SELECT loan_sequence_number,
  CAST(make_date(monthly_reporting_period // 100, monthly_reporting_period % 100, 1) AS VARCHAR) AS month_from_number,
  CAST(make_date(monthly_reporting_period // 100, monthly_reporting_period % 100, 1) AS VARCHAR) AS month_from_text,
  CAST(CASE WHEN monthly_reporting_period % 100 + 3 <= 12
    THEN make_date(monthly_reporting_period // 100, monthly_reporting_period % 100 + 3, 1) END AS VARCHAR) AS month_or_null
FROM perf_fx""")
def _(spark, sf):
    month = F.col("monthly_reporting_period")
    return t.raw_performance(spark, sf).select(
        "loan_sequence_number", cleaning.month_date(month).alias("month_from_number"),
        cleaning.month_date(month.cast("double").cast("long").cast("string")).alias("month_from_text"),
        cleaning.month_date(month + 3).alias("month_or_null"))


@query("pad_postal", """
SELECT loan_sequence_number, CASE WHEN length(postal_code3_trunc) < 5 THEN lpad(postal_code3_trunc, 5, '0')
  ELSE postal_code3_trunc END AS postal_code3_trunc FROM orig_fx""")
def _(spark, sf):
    return t.raw_origination(spark, sf).select(
        "loan_sequence_number", cleaning.pad_postal("postal_code3_trunc").alias("postal_code3_trunc"))


@query("net_sale_proceeds", """
SELECT loan_sequence_number, monthly_reporting_period, TRY_CAST(nullif(net_sale_proceeds, 'U') AS DOUBLE) AS net_sale_proceeds
FROM perf_fx""")
def _(spark, sf):
    return t.raw_performance(spark, sf).select(
        *ID, cleaning.sale_proceeds("net_sale_proceeds").alias("net_sale_proceeds"))


@query("dpd_numeric", f"SELECT {LOAN_MONTH}, dpd_numerico FROM staged_rows")
def _(spark, sf):
    return t.performance(spark, sf).select(
        *ID, delinquency.dpd_numeric("current_loan_delinquency_status").alias("dpd_numerico"))


@query("dpd_days", f"SELECT {LOAN_MONTH}, dpd FROM quick")
def _(spark, sf):
    return t.quick(spark, sf).select(*ID, "dpd")


@query("default_event", f"SELECT {LOAN_MONTH}, evento_default FROM staged_rows")
def _(spark, sf):
    return t.staged(spark, sf).select(*ID, "evento_default")


@query("default_flag_quick", f"SELECT {LOAN_MONTH}, default_flag_quick FROM quick")
def _(spark, sf):
    return t.quick(spark, sf).select(*ID, "default_flag_quick")


@query("assign_stage", f"SELECT {LOAN_MONTH}, ifrs9_stage FROM staged_rows")
def _(spark, sf):
    return t.staged(spark, sf).select(*ID, "ifrs9_stage")


@query("dpd_bucket", f"""
SELECT {LOAN_MONTH}, CASE WHEN dpd_numerico = 0 THEN '0' WHEN dpd_numerico = 1 THEN '30'
  WHEN dpd_numerico = 2 THEN '60' WHEN dpd_numerico >= 3 THEN '3+' ELSE 'unknown' END AS bucket
FROM staged_rows""")
def _(spark, sf):
    return t.staged(spark, sf).select(*ID, delinquency.dpd_bucket("dpd_numerico").alias("bucket"))


def _featured(spark, sf):
    return loans.add_features(t.panel(spark, sf))


@query("rate_spread", f"""
SELECT {LOAN_MONTH}, current_interest_rate - original_interest_rate AS spread_tasa FROM panel""")
def _(spark, sf):
    return _featured(spark, sf).select(*ID, "spread_tasa")


@query("upb_amortization", f"""
SELECT {LOAN_MONTH}, CASE WHEN a > 1 THEN 1 WHEN a < 0 THEN 0 ELSE a END AS amortizacion_upb
FROM (SELECT *, 1 - current_actual_upb / nullif(original_upb, 0) AS a FROM panel)""")
def _(spark, sf):
    return _featured(spark, sf).select(*ID, "amortizacion_upb")


@query("binary_flags", f"""
SELECT {LOAN_MONTH}, CASE WHEN modification_flag IN ('Y', 'P') THEN 1 ELSE 0 END AS fue_modificado,
  CASE WHEN payment_deferral_flag IN ('Y', 'P') THEN 1 ELSE 0 END AS tiene_deferral FROM perf""")
def _(spark, sf):
    return t.performance(spark, sf).select(
        *ID, features.yes_or_past("modification_flag").alias("fue_modificado"),
        features.yes_or_past("payment_deferral_flag").alias("tiene_deferral"))


@query("eltv_clean", f"""
SELECT {LOAN_MONTH}, nullif(estimated_loan_to_value_eltv, 999) AS estimated_loan_to_value_eltv FROM perf""")
def _(spark, sf):
    return t.performance(spark, sf).select(
        *ID, features.known_eltv().alias("estimated_loan_to_value_eltv"))


SCENARIO_ROWS = """
SELECT 'base' AS scenario, CAST(0.5 AS DOUBLE) AS weight, CAST(1.0 AS DOUBLE) AS hpi_factor, 0 AS un_shift, CAST(0 AS DOUBLE) AS ff_shift
UNION ALL SELECT 'pessimistic', 0.3, 0.75, 4, -2.5
UNION ALL SELECT 'optimistic', 0.2, 1.02, -1, 0"""
SHOCKED_ROWS = """
SELECT d.* EXCLUDE (hpi, hpi_yoy_change, unemployment_rate, unemployment_yoy_change, fed_funds_rate),
  s.scenario, s.weight, hpi * hpi_factor AS hpi,
  hpi_yoy_change + (hpi_factor - 1) * 100 AS hpi_yoy_change,
  CASE WHEN unemployment_rate + un_shift < 0 THEN 0 ELSE unemployment_rate + un_shift END AS unemployment_rate,
  unemployment_yoy_change + un_shift AS unemployment_yoy_change,
  CASE WHEN fed_funds_rate + ff_shift < 0 THEN 0 ELSE fed_funds_rate + ff_shift END AS fed_funds_rate
FROM dataset d, scenario_rows s WHERE d.vintage_year = 2024"""


@query("scenario_shock", f"""
SELECT {LOAN_MONTH}, scenario, weight, round(hpi, 6) AS hpi, round(hpi_yoy_change, 6) AS hpi_yoy_change,
  unemployment_rate, unemployment_yoy_change, fed_funds_rate FROM shocked_rows""",
       scenario_rows=SCENARIO_ROWS, shocked_rows=SHOCKED_ROWS)
def _(spark, sf):
    test = t.dataset(spark, sf).filter(F.col("vintage_year").isin(schema.TEST_VINTAGES))
    return scenario_shock(test).select(
        *ID, "scenario", "weight", F.round("hpi", 6).alias("hpi"),
        F.round("hpi_yoy_change", 6).alias("hpi_yoy_change"), "unemployment_rate",
        "unemployment_yoy_change", "fed_funds_rate")


@query("vintage_from_date", """
SELECT trim(loan_sequence_number) AS loan_sequence_number,
  substr(CAST(first_payment_date AS VARCHAR), 1, 4) AS first_payment_year,
  substr(trim(loan_sequence_number), 3, 2) AS id_vintage FROM orig_fx""")
def _(spark, sf):
    loan = cleaning.join_key("loan_sequence_number")
    return t.raw_origination(spark, sf).select(
        loan.alias("loan_sequence_number"),
        cleaning.first_payment_year("first_payment_date").alias("first_payment_year"),
        cleaning.loan_id_vintage(loan).alias("id_vintage"))


@query("fallback_upb", """
SELECT id_loan, period, coalesce(nullif(curr_act_upb, 0), nullif(prior_upb, 0), orig_upb) AS upb FROM sas_history""")
def _(spark, sf):
    return t.loan_history(spark, sf).select(
        "id_loan", "period", loan_master.balance("curr_act_upb", "prior_upb").alias("upb"))


@query("fallback_rate", """
SELECT id_loan, period, coalesce(nullif(cur_int_rt, 0), prior_int_rt) AS rate FROM sas_history""")
def _(spark, sf):
    return t.loan_history(spark, sf).select(
        "id_loan", "period", cleaning.fallback(F.col("cur_int_rt"), F.col("prior_int_rt")).alias("rate"))


@query("period_diff", "SELECT id_loan, period, period_diff FROM sas_history")
def _(spark, sf):
    return t.loan_history(spark, sf).select("id_loan", "period", "period_diff")


@query("delq_recode_ra", "SELECT id_loan, period, delq_sts, delq_sts_new FROM sas_history")
def _(spark, sf):
    return t.loan_history(spark, sf).select("id_loan", "period", "delq_sts", "delq_sts_new")


@query("transition_strings", "SELECT id_loan, delq_string, month_string FROM sas_terminal")
def _(spark, sf):
    return loan_master.terminal_record(t.loan_history(spark, sf)).select(
        "id_loan", "delq_string", "month_string")


@query("month_year_parts", f"""
SELECT {LOAN_MONTH}, CAST(year(monthly_reporting_period) AS INTEGER) AS year FROM perf""")
def _(spark, sf):
    return t.performance(spark, sf).select(*ID, F.year("monthly_reporting_period").alias("year"))


@query("psi_status", """
SELECT obs_id, p, CASE WHEN p < 0.1 THEN 'stable' WHEN p < 0.25 THEN 'monitor' ELSE 'unstable' END AS status
FROM score_fx""")
def _(spark, sf):
    return t.scores(spark, sf).select("obs_id", "p", delinquency.psi_status("p").alias("status"))


# --- filters and samples ----------------------------------------------------


@query("active_stages", f"SELECT {LOAN_MONTH}, ifrs9_stage FROM staged_rows WHERE ifrs9_stage IN (1, 2)")
def _(spark, sf):
    return summaries.active(t.staged(spark, sf)).select(*ID, "ifrs9_stage")


SPLIT = """CASE WHEN vintage_year BETWEEN 2016 AND 2020 THEN 'train' WHEN vintage_year IN (2022, 2023)
  THEN 'validation' WHEN vintage_year = 2024 THEN 'test' END"""


@query("temporal_split", f"""
SELECT {LOAN_MONTH}, vintage_year, split FROM (SELECT *, {SPLIT} AS split FROM panel) WHERE split IS NOT NULL""")
def _(spark, sf):
    return summaries.temporal_split(t.panel(spark, sf)).select(*ID, "vintage_year", "split")


@query("min_obs", """
SELECT loan_age, count(*) AS n_obs FROM perf GROUP BY 1 HAVING count(*) >= 100""")
def _(spark, sf):
    per_age = t.performance(spark, sf).groupBy("loan_age").agg(summaries.rows().alias("n_obs"))
    return summaries.min_obs(per_age, "n_obs", 100)


@query("loan_lookup", f"""
SELECT {LOAN_MONTH}, current_loan_delinquency_status, current_actual_upb FROM perf
WHERE loan_sequence_number = 'F00000000007'""")
def _(spark, sf):
    return joins.loan_lookup(t.performance(spark, sf), "F00000000007").select(
        *ID, "current_loan_delinquency_status", "current_actual_upb")


@query("dpd_range", """
SELECT dpd // 30 * 30 AS dpd_from, count(*) AS n FROM quick WHERE dpd > 0 AND dpd < 450 GROUP BY 1""")
def _(spark, sf):
    return summaries.dpd_range(t.quick(spark, sf)).select(F.col("dpd_from").cast("int"), "n")


SAMPLE_HASH = "md5(loan_sequence_number || '|' || CAST(monthly_reporting_period AS VARCHAR) || '|42')"


@query("random_subsample", f"""
SELECT {LOAN_MONTH}, current_actual_upb FROM (
  SELECT *, row_number() OVER (ORDER BY {SAMPLE_HASH}) AS pos FROM perf) WHERE pos <= 5000""")
def _(spark, sf):
    return sampling.random_subsample(t.performance(spark, sf), 5000, ID).select(*ID, "current_actual_upb")


@query("stratified_sample", f"""
SELECT {LOAN_MONTH}, default_12m FROM (
  SELECT *, row_number() OVER (PARTITION BY default_12m ORDER BY {SAMPLE_HASH}) AS pos,
    count(*) OVER (PARTITION BY default_12m) AS size, count(*) OVER () AS total
  FROM dataset WHERE vintage_year = 2024)
WHERE total <= 2000 OR pos <= least(size, CAST(floor(2000 * size / total) AS BIGINT))""")
def _(spark, sf):
    test = summaries.active(t.labelled(spark, sf)).filter(F.col("vintage_year") == 2024)
    return sampling.stratified_sample(test, 2000, ID, ["default_12m"]).select(*ID, "default_12m")
