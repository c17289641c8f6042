"""Loan-shaped views of the given tables, in Spark and as SQL common tables.

A part is a loan, and its distinct shipping months are the loan's reporting months.
All values are whole numbers before they become doubles, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditspark import schema
from creditspark.functions.cleaning import clear_codes, join_key
from creditspark.models.preprocessing import fit_levels
from creditspark.operators import history, joins, macro
from creditspark.plans import loan_master, loans


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def loan_id(p: str) -> str:
    return f"concat('F', lpad(cast({p} AS string), 11, '0'))"


def vintage(p: str) -> str:
    return f"cast(2016 + {p} % 8 + CASE WHEN {p} % 8 > 4 THEN 1 ELSE 0 END AS int)"


def raw_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The derived numbers are aggregates, so filters on what follows from them stay
    # above the grouping instead of being unfolded into the scan.
    months = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS p", "year(l_shipdate) AS y", "month(l_shipdate) AS mo")
    keyed = months.groupBy("p", "y", "mo").agg(
        F.expr("max(y * 100 + mo) AS ym"), F.expr("max((y - 1995) * 12 + mo - 1) AS age"),
        F.expr("max(p * 7 + y * 12 + mo) AS k"))
    return keyed.selectExpr(
        f"{loan_id('p')} AS loan_sequence_number",
        "ym AS monthly_reporting_period",
        "cast(greatest(0, 50000 + (p % 40) * 5000 - age * 450) AS double) AS current_actual_upb",
        """CASE WHEN k % 307 = 0 THEN NULL WHEN k % 173 < 3 THEN '1' WHEN k % 173 < 5 THEN '2'
             WHEN k % 173 < 7 THEN '3' WHEN k % 173 = 7 THEN '4' WHEN k % 173 = 8 THEN '5'
             WHEN k % 173 = 9 THEN CASE WHEN p % 3 = 0 THEN 'RA' ELSE '6' END ELSE '0' END
           AS current_loan_delinquency_status""",
        "cast(age AS double) AS loan_age",
        "CASE k % 53 WHEN 0 THEN 'Y' WHEN 1 THEN 'P' END AS modification_flag",
        "CASE k % 59 WHEN 0 THEN 'Y' WHEN 1 THEN 'P' END AS payment_deferral_flag",
        """CASE k % 401 WHEN 0 THEN '02' WHEN 1 THEN '03' WHEN 2 THEN '09' WHEN 3 THEN '01'
             WHEN 4 THEN '15' WHEN 5 THEN '96' END AS zero_balance_code""",
        """cast(30 + p % 30 AS double) / 10D - CASE WHEN k % 53 < 2 THEN 0.5D ELSE 0D END
           AS current_interest_rate""",
        """CASE WHEN ym < 199704 THEN NULL WHEN k % 67 = 0 THEN 999D ELSE cast(40 + k % 60 AS double) END
           AS estimated_loan_to_value_eltv""",
        """CASE WHEN k % 73 = 0 THEN 'U' WHEN k % 73 BETWEEN 1 AND 3 THEN cast(1000 + k % 500 AS string) END
           AS net_sale_proceeds""",
        f"{vintage('p')} AS vintage_year",
    )


def _coded(every: int, code: int, value: str, name: str) -> str:
    return f"CASE WHEN p % {every} = 0 THEN {code}D ELSE cast({value} AS double) END AS {name}"


def _choice(values: list[str], name: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(p % {len(values)} + 1 AS int)) AS {name}"


def raw_origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS p").filter("p % 109 <> 0")
    return parts.selectExpr(
        f"concat(' ', {loan_id('p')}, ' ') AS loan_sequence_number",
        _coded(97, 9999, "580 + (p * 13) % 250", "credit_score"),
        "cast((1995 + p % 5) * 100 + 1 + p % 12 AS int) AS first_payment_date",
        _coded(101, 99, "1 + p % 4", "number_of_units"),
        _coded(103, 99, "1 + p % 2", "number_of_borrowers"),
        _coded(89, 999, "40 + (p * 11) % 60", "original_ltv"),
        _coded(89, 999, "42 + (p * 11) % 60", "original_cltv"),
        _coded(83, 999, "10 + (p * 17) % 45", "original_dti"),
        "cast(50000 + (p % 40) * 5000 AS double) AS original_upb",
        "cast(30 + p % 30 AS double) / 10D AS original_interest_rate",
        "CASE WHEN p % 3 = 0 THEN 180D ELSE 360D END AS original_loan_term",
        _choice(["P", "I", "S", "9"], "occupancy_status"),
        _choice(["R", "B", "C", "R", "9"], "channel"),
        _choice(["P", "C", "N", "9"], "loan_purpose"),
        _choice(["SF", "PU", "CO", "MH", "CP", "99"], "property_type"),
        "CASE WHEN p % 7 = 0 THEN 'ARM' ELSE 'FRM' END AS amortization_type",
        "cast((p % 900) * 100 AS string) AS postal_code3_trunc",
        f"{vintage('p')} AS vintage_year",
    )


TEXT_CODES = {c: v for c, v in schema.ORIGINATION_CODES.items() if c in (
    "occupancy_status", "channel", "property_type", "loan_purpose")}


def origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clear_codes(loans.prepare_origination(raw_origination(spark, sf_dir)), TEXT_CODES)


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans.prepare_performance(raw_performance(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.build_panel(performance(spark, sf_dir), origination(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str, rolling: bool = False) -> DataFrame:
    return loans.labelled_panel(
        performance(spark, sf_dir), origination(spark, sf_dir), rolling=rolling
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance rows with the row-level default columns only."""
    return history.default_columns(performance(spark, sf_dir))


def quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans.quick_flags(performance(spark, sf_dir))


def with_scores(df: DataFrame) -> DataFrame:
    """Given probabilities: small fractions that depend on loan and month."""
    return df.withColumns({
        "pd_origination": F.expr("cast(cast(substr(loan_sequence_number, 2) AS bigint) * 31 % 89 AS double) / 2000D"),
        "pd_current": F.expr(
            "cast((cast(substr(loan_sequence_number, 2) AS bigint) * 17 + cast(loan_age AS bigint) * 5) % 97 + 1"
            " AS double) / 1000D"),
    })


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(labelled(spark, sf_dir))


def levels(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Levels of the loans that have months, as the panel shows them."""
    seen = table(spark, sf_dir, "lineitem").selectExpr(f"{loan_id('l_partkey')} AS loan_sequence_number")
    return fit_levels(
        origination(spark, sf_dir).join(seen, "loan_sequence_number", "left_semi"), schema.CATEGORICAL
    )


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, value): monthly, quarterly and weekly series of the order dates."""
    days = table(spark, sf_dir, "orders").selectExpr("to_date(o_orderdate) AS day").distinct()
    months = days.selectExpr("trunc(day, 'MM') AS date").distinct().selectExpr(
        "date", "(year(date) - 1995) * 12 + month(date) + 100 AS v", "month(date) IN (1, 4, 7, 10) AS quarter")
    monthly = months.selectExpr("date", """stack(4,
        'USSTHPI', cast(v * 3 + v % 5 AS double), quarter, 'UNRATE', cast(v % 7 + 3 AS double), true,
        'FEDFUNDS', cast(v % 5 AS double), true, 'GDPC1', cast(v * 10 AS double), quarter)
        AS (series_id, value, kept)""").filter("kept").select("series_id", "date", "value")
    weekly = days.selectExpr("trunc(day, 'week') AS date").distinct().selectExpr(
        "'MORTGAGE30US' AS series_id", "date", "cast(day(date) + 300 AS double) AS value")
    return monthly.unionByName(weekly)


def macro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.macro_monthly(macro_series(spark, sf_dir))


def dataset(spark: SparkSession, sf_dir: str, with_macro: bool = True, encode: bool = True) -> DataFrame:
    """Modelling rows; without `encode` code columns stay text and no levels are looked for."""
    return loans.feature_dataset(
        labelled(spark, sf_dir, rolling=True), macro_table(spark, sf_dir) if with_macro else None,
        levels(spark, sf_dir) if encode else None, encode=encode,
    )


def scores(spark: SparkSession, sf_dir: str, signal: bool = False) -> DataFrame:
    """(obs_id, y, p, yr) of the orders; `signal` ties the score to the outcome."""
    price = F.floor("o_totalprice") % 200
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    p = (price + y * 40).cast("double") / 240 if signal else price.cast("double") / 200
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"), y.alias("y"), p.alias("p"),
        F.year("o_orderdate").alias("yr"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores stacked as two models."""
    plain = scores(spark, sf_dir).withColumn("model", F.lit("plain"))
    signal = scores(spark, sf_dir, signal=True).withColumn("model", F.lit("signal"))
    return plain.unionByName(signal)


def short_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loan_master.short_names(raw_performance(spark, sf_dir).drop("vintage_year"))


def short_origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = loan_master.short_names(raw_origination(spark, sf_dir).drop("vintage_year"))
    return df.withColumn("id_loan", join_key("id_loan"))


def loan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct performance rows of known loans, original balance, lagged values."""
    detail = loan_master.history_detail(short_performance(spark, sf_dir), short_origination(spark, sf_dir))
    return history.lag_features(detail)


def shown(df: DataFrame) -> DataFrame:
    """Dates as text."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})


COMMON_TABLES = """
months_fx AS (
  SELECT DISTINCT l_partkey AS p, year(l_shipdate) AS y, month(l_shipdate) AS mo FROM lineitem
), keyed_fx AS (
  SELECT p, CAST(y * 100 + mo AS INTEGER) AS ym, (y - 1995) * 12 + mo - 1 AS age, p * 7 + y * 12 + mo AS k
  FROM months_fx
), perf_fx AS (
  SELECT 'F' || lpad(CAST(p AS VARCHAR), 11, '0') AS loan_sequence_number,
    ym AS monthly_reporting_period,
    CAST(greatest(0, 50000 + (p % 40) * 5000 - age * 450) AS DOUBLE) AS current_actual_upb,
    CASE WHEN k % 307 = 0 THEN NULL WHEN k % 173 < 3 THEN '1' WHEN k % 173 < 5 THEN '2'
      WHEN k % 173 < 7 THEN '3' WHEN k % 173 = 7 THEN '4' WHEN k % 173 = 8 THEN '5'
      WHEN k % 173 = 9 THEN CASE WHEN p % 3 = 0 THEN 'RA' ELSE '6' END ELSE '0' END
      AS current_loan_delinquency_status,
    CAST(age AS DOUBLE) AS loan_age,
    CASE k % 53 WHEN 0 THEN 'Y' WHEN 1 THEN 'P' END AS modification_flag,
    CASE k % 59 WHEN 0 THEN 'Y' WHEN 1 THEN 'P' END AS payment_deferral_flag,
    CASE k % 401 WHEN 0 THEN '02' WHEN 1 THEN '03' WHEN 2 THEN '09' WHEN 3 THEN '01'
      WHEN 4 THEN '15' WHEN 5 THEN '96' END AS zero_balance_code,
    CAST(30 + p % 30 AS DOUBLE) / CAST(10 AS DOUBLE)
      - CAST(CASE WHEN k % 53 < 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS current_interest_rate,
    CAST(CASE WHEN ym < 199704 THEN NULL WHEN k % 67 = 0 THEN 999 ELSE 40 + k % 60 END AS DOUBLE)
      AS estimated_loan_to_value_eltv,
    CASE WHEN k % 73 = 0 THEN 'U' WHEN k % 73 BETWEEN 1 AND 3 THEN CAST(1000 + k % 500 AS VARCHAR) END
      AS net_sale_proceeds,
    CAST(2016 + p % 8 + CASE WHEN p % 8 > 4 THEN 1 ELSE 0 END AS INTEGER) AS vintage_year
  FROM keyed_fx
), orig_fx AS (
  SELECT ' F' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || ' ' AS loan_sequence_number,
    CAST(CASE WHEN p % 97 = 0 THEN 9999 ELSE 580 + (p * 13) % 250 END AS DOUBLE) AS credit_score,
    CAST((1995 + p % 5) * 100 + 1 + p % 12 AS INTEGER) AS first_payment_date,
    CAST(CASE WHEN p % 101 = 0 THEN 99 ELSE 1 + p % 4 END AS DOUBLE) AS number_of_units,
    CAST(CASE WHEN p % 103 = 0 THEN 99 ELSE 1 + p % 2 END AS DOUBLE) AS number_of_borrowers,
    CAST(CASE WHEN p % 89 = 0 THEN 999 ELSE 40 + (p * 11) % 60 END AS DOUBLE) AS original_ltv,
    CAST(CASE WHEN p % 89 = 0 THEN 999 ELSE 42 + (p * 11) % 60 END AS DOUBLE) AS original_cltv,
    CAST(CASE WHEN p % 83 = 0 THEN 999 ELSE 10 + (p * 17) % 45 END AS DOUBLE) AS original_dti,
    CAST(50000 + (p % 40) * 5000 AS DOUBLE) AS original_upb,
    CAST(30 + p % 30 AS DOUBLE) / CAST(10 AS DOUBLE) AS original_interest_rate,
    CAST(CASE WHEN p % 3 = 0 THEN 180 ELSE 360 END AS DOUBLE) AS original_loan_term,
    CASE p % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'I' WHEN 2 THEN 'S' ELSE '9' END AS occupancy_status,
    CASE p % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'R' ELSE '9' END AS channel,
    CASE p % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'C' WHEN 2 THEN 'N' ELSE '9' END AS loan_purpose,
    CASE p % 6 WHEN 0 THEN 'SF' WHEN 1 THEN 'PU' WHEN 2 THEN 'CO' WHEN 3 THEN 'MH' WHEN 4 THEN 'CP'
      ELSE '99' END AS property_type,
    CASE WHEN p % 7 = 0 THEN 'ARM' ELSE 'FRM' END AS amortization_type,
    CAST((p % 900) * 100 AS VARCHAR) AS postal_code3_trunc,
    CAST(2016 + p % 8 + CASE WHEN p % 8 > 4 THEN 1 ELSE 0 END AS INTEGER) AS vintage_year
  FROM (SELECT *, p_partkey AS p FROM part) WHERE p % 109 <> 0
), perf AS (
  SELECT * REPLACE (
    make_date(monthly_reporting_period // 100, monthly_reporting_period % 100, 1) AS monthly_reporting_period,
    TRY_CAST(nullif(net_sale_proceeds, 'U') AS DOUBLE) AS net_sale_proceeds)
  FROM perf_fx
), orig AS (
  SELECT trim(loan_sequence_number) AS loan_sequence_number,
    nullif(credit_score, 9999) AS credit_score,
    make_date(first_payment_date // 100, first_payment_date % 100, 1) AS first_payment_date,
    nullif(number_of_units, 99) AS number_of_units, nullif(number_of_borrowers, 99) AS number_of_borrowers,
    nullif(original_ltv, 999) AS original_ltv, nullif(original_cltv, 999) AS original_cltv,
    nullif(original_dti, 999) AS original_dti, original_upb, original_interest_rate, original_loan_term,
    nullif(occupancy_status, '9') AS occupancy_status, nullif(channel, '9') AS channel,
    nullif(loan_purpose, '9') AS loan_purpose, nullif(property_type, '99') AS property_type,
    amortization_type,
    CASE WHEN length(postal_code3_trunc) < 5 THEN lpad(postal_code3_trunc, 5, '0') ELSE postal_code3_trunc END
      AS postal_code3_trunc,
    vintage_year
  FROM orig_fx
), panel AS (
  SELECT p.* EXCLUDE (vintage_year), o.* EXCLUDE (loan_sequence_number)
  FROM perf p LEFT JOIN orig o ON p.loan_sequence_number = o.loan_sequence_number
), staged_rows AS (
  SELECT *, CASE WHEN evento_default THEN 3 WHEN dpd_numerico BETWEEN 1 AND 2 THEN 2 ELSE 1 END AS ifrs9_stage
  FROM (
    SELECT *, coalesce(dpd_numerico >= 3, false)
      OR coalesce(zero_balance_code IN ('02', '03', '09'), false) AS evento_default
    FROM (
      SELECT *, CASE WHEN current_loan_delinquency_status = 'RA' THEN CAST(99 AS DOUBLE)
        ELSE TRY_CAST(current_loan_delinquency_status AS DOUBLE) END AS dpd_numerico
      FROM panel))
), labelled AS (
  SELECT *,
    CAST(coalesce(max(CAST(evento_default AS INTEGER)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0)
      AS INTEGER) AS default_12m,
    max(dpd_numerico) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max_dpd_3m,
    max(dpd_numerico) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS max_dpd_6m,
    max(dpd_numerico) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS max_dpd_12m
  FROM staged_rows
  WINDOW w AS (PARTITION BY loan_sequence_number ORDER BY monthly_reporting_period)
), quick AS (
  SELECT *, CAST((dpd >= 90) OR coalesce(zero_balance_code IN ('02', '03', '09'), false) AS INTEGER)
    AS default_flag_quick
  FROM (
    SELECT *, 30 * TRY_CAST(current_loan_delinquency_status AS INTEGER) AS dpd FROM perf)
), scored AS (
  SELECT *,
    CAST((CAST(substr(loan_sequence_number, 2) AS BIGINT) * 31) % 89 AS DOUBLE) / CAST(2000 AS DOUBLE)
      AS pd_origination,
    CAST((CAST(substr(loan_sequence_number, 2) AS BIGINT) * 17 + CAST(loan_age AS BIGINT) * 5) % 97 + 1 AS DOUBLE)
      / CAST(1000 AS DOUBLE) AS pd_current
  FROM labelled
), macro_days AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
), macro_months AS (
  SELECT date, (year(date) - 1995) * 12 + month(date) + 100 AS v
  FROM (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS date FROM macro_days)
), macro_raw AS (
  SELECT 'USSTHPI' AS series_id, date, CAST(v * 3 + v % 5 AS DOUBLE) AS value FROM macro_months
    WHERE month(date) IN (1, 4, 7, 10)
  UNION ALL SELECT 'UNRATE', date, CAST(v % 7 + 3 AS DOUBLE) FROM macro_months
  UNION ALL SELECT 'FEDFUNDS', date, CAST(v % 5 AS DOUBLE) FROM macro_months
  UNION ALL SELECT 'GDPC1', date, CAST(v * 10 AS DOUBLE) FROM macro_months WHERE month(date) IN (1, 4, 7, 10)
  UNION ALL SELECT 'MORTGAGE30US', date, CAST(day(date) + 300 AS DOUBLE)
    FROM (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS date FROM macro_days)
), macro_quarterly AS (
  SELECT series_id, CAST(unnest(generate_series(date, last, INTERVAL 1 MONTH)) AS DATE) AS date, value
  FROM (
    SELECT series_id, date, value,
      coalesce(CAST(lead(date) OVER (PARTITION BY series_id ORDER BY date) - INTERVAL 1 MONTH AS DATE), date) AS last
    FROM macro_raw WHERE series_id IN ('USSTHPI', 'GDPC1'))
), macro_weekly AS (
  SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value
  FROM macro_raw WHERE series_id = 'MORTGAGE30US' GROUP BY 1, 2
), macro_last AS (
  SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(value, date) AS value
  FROM macro_raw WHERE series_id IN ('UNRATE', 'FEDFUNDS') GROUP BY 1, 2
), macro_aligned AS (
  SELECT date,
    max(CASE WHEN series_id = 'USSTHPI' THEN value END) AS hpi,
    max(CASE WHEN series_id = 'UNRATE' THEN value END) AS unemployment_rate,
    max(CASE WHEN series_id = 'FEDFUNDS' THEN value END) AS fed_funds_rate,
    max(CASE WHEN series_id = 'GDPC1' THEN value END) AS gdp_real,
    max(CASE WHEN series_id = 'MORTGAGE30US' THEN value END) AS mortgage_rate_30y
  FROM (SELECT * FROM macro_quarterly UNION ALL SELECT * FROM macro_weekly UNION ALL SELECT * FROM macro_last)
  GROUP BY date
), macro_monthly AS (
  SELECT * EXCLUDE (hpi_filled),
    (hpi_filled / nullif(lag(hpi_filled, 12) OVER (ORDER BY date), 0) - 1) * 100 AS hpi_yoy_change,
    unemployment_rate - lag(unemployment_rate, 12) OVER (ORDER BY date) AS unemployment_yoy_change
  FROM (
    SELECT *, last_value(hpi IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS hpi_filled
    FROM macro_aligned)
), features AS (
  SELECT l.* EXCLUDE (loan_purpose, property_type, occupancy_status, channel, amortization_type,
      estimated_loan_to_value_eltv, modification_flag, payment_deferral_flag),
    current_interest_rate - original_interest_rate AS spread_tasa,
    CASE WHEN a > 1 THEN 1 WHEN a < 0 THEN 0 ELSE a END AS amortizacion_upb,
    CASE WHEN modification_flag IN ('Y', 'P') THEN 1 ELSE 0 END AS fue_modificado,
    CASE WHEN payment_deferral_flag IN ('Y', 'P') THEN 1 ELSE 0 END AS tiene_deferral,
    nullif(estimated_loan_to_value_eltv, 999) AS estimated_loan_to_value_eltv,
    m.* EXCLUDE (date),
    CAST(CASE WHEN loan_purpose IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY loan_purpose NULLS LAST) - 1 END AS INTEGER) AS loan_purpose,
    CAST(CASE WHEN property_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY property_type NULLS LAST) - 1 END AS INTEGER) AS property_type,
    CAST(CASE WHEN occupancy_status IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY occupancy_status NULLS LAST) - 1 END AS INTEGER) AS occupancy_status,
    CAST(CASE WHEN channel IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY channel NULLS LAST) - 1 END AS INTEGER) AS channel,
    CAST(CASE WHEN amortization_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY amortization_type NULLS LAST) - 1 END AS INTEGER) AS amortization_type
  FROM (SELECT *, 1 - current_actual_upb / nullif(original_upb, 0) AS a FROM labelled) l
  LEFT JOIN macro_monthly m ON l.monthly_reporting_period = m.date
), dataset AS (
  SELECT * EXCLUDE (a) FROM features WHERE ifrs9_stage IN (1, 2)
), score_fx AS (
  SELECT o_orderkey AS obs_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 200 AS DOUBLE) / CAST(200 AS DOUBLE) AS p,
    CAST(year(o_orderdate) AS INTEGER) AS yr
  FROM orders
), score_sig_fx AS (
  SELECT o_orderkey AS obs_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 200 + CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END AS DOUBLE)
      / CAST(240 AS DOUBLE) AS p,
    CAST(year(o_orderdate) AS INTEGER) AS yr
  FROM orders
), model_scores AS (
  SELECT *, 'plain' AS model FROM score_fx UNION ALL SELECT *, 'signal' AS model FROM score_sig_fx
), sas_detail AS (
  SELECT DISTINCT p.loan_sequence_number AS id_loan, monthly_reporting_period AS period,
    current_actual_upb AS curr_act_upb, current_loan_delinquency_status AS delq_sts, loan_age,
    modification_flag AS flag_mod, payment_deferral_flag AS dpm_ind, zero_balance_code AS cd_zero_bal,
    current_interest_rate AS cur_int_rt, estimated_loan_to_value_eltv AS eltv, net_sale_proceeds,
    o.original_upb AS orig_upb
  FROM perf_fx p JOIN orig_fx o ON p.loan_sequence_number = trim(o.loan_sequence_number)
), sas_lagged AS (
  SELECT *,
    CASE WHEN rn = 1 THEN CAST(0 AS DOUBLE) ELSE lag(curr_act_upb) OVER w END AS prior_upb,
    CASE WHEN rn = 1 THEN cur_int_rt ELSE lag(cur_int_rt) OVER w END AS prior_int_rt,
    CASE WHEN rn = 1 THEN '00' ELSE lag(delq_sts) OVER w END AS prior_delq_sts,
    CASE WHEN rn = 1 THEN '00' ELSE lag(delq_sts, 2) OVER w END AS prior_delq_sts_2,
    lag(period) OVER w AS prior_period
  FROM (SELECT *, row_number() OVER (PARTITION BY id_loan ORDER BY period) AS rn FROM sas_detail)
  WINDOW w AS (PARTITION BY id_loan ORDER BY period)
), sas_history AS (
  SELECT * EXCLUDE (rn), CASE WHEN delq_sts <> 'RA' THEN delq_sts
      WHEN delq_sts = 'RA' AND period_diff = 1 AND prior_delq_sts = '5' THEN '6'
      WHEN delq_sts = 'RA' AND period_diff = 1 AND prior_delq_sts = '3' THEN '4'
      WHEN delq_sts = 'RA' AND period_diff = 1 AND prior_delq_sts = '2' THEN '3' END AS delq_sts_new
  FROM (
    SELECT *, (period // 100 - prior_period // 100) * 12 + period % 100 - prior_period % 100 AS period_diff
    FROM sas_lagged)
), sas_first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id_loan, delq_sts_new ORDER BY period) AS pos
    FROM sas_history WHERE delq_sts_new IN ('1', '2', '3', '4', '6')) WHERE pos = 1
), sas_balance AS (
  SELECT id_loan, CAST(delq_sts_new AS INTEGER) AS bucket, period, 1 AS dlq_ind,
    coalesce(nullif(curr_act_upb, 0), nullif(prior_upb, 0), orig_upb) AS dlq_upb
  FROM sas_first
), sas_d180 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id_loan ORDER BY period) AS pos FROM sas_history
    WHERE coalesce(delq_sts_new = '6', false)
      OR ((coalesce(cd_zero_bal IN ('02', '03', '15'), false) OR coalesce(delq_sts = 'RA', false))
        AND NOT coalesce(TRY_CAST(delq_sts_new AS DOUBLE) >= 6, false))) WHERE pos = 1
), sas_mod AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id_loan ORDER BY period) AS pos FROM sas_history
    WHERE flag_mod = 'Y') WHERE pos = 1
), sas_terminal AS (
  SELECT * EXCLUDE (pos),
    CASE WHEN cd_zero_bal IN ('02', '03', '09', '15')
      THEN coalesce(nullif(curr_act_upb, 0), nullif(prior_upb, 0), orig_upb) END AS default_upb,
    coalesce(prior_delq_sts, '') || ' to ' || coalesce(delq_sts, '') AS delq_string,
    coalesce(CAST(prior_period AS VARCHAR), '.') || ' to ' || coalesce(CAST(period AS VARCHAR), '.') AS month_string,
    coalesce(nullif(cur_int_rt, 0), prior_int_rt) AS current_int_rt,
    substr(id_loan, 3, 2) AS vintage
  FROM (
    SELECT *, row_number() OVER (PARTITION BY id_loan ORDER BY period DESC) AS pos FROM sas_history)
  WHERE pos = 1
)"""


def sql(body: str, **extra: str) -> str:
    """The common tables, any extra ones, and the query."""
    more = "".join(f", {name} AS ({text})" for name, text in extra.items())
    return f"WITH {COMMON_TABLES.strip()}{more}\n{body}"
