"""Base tables, labelled panel and modelling dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning, delinquency, features
from creditspark.models.preprocessing import encode_levels
from creditspark.operators import history, joins
from creditspark.operators.summaries import active

KEPT = [
    schema.LOAN, schema.MONTH, schema.VINTAGE, "ifrs9_stage", schema.TARGET,
    "dpd_numerico", "evento_default", "current_actual_upb", "current_interest_rate",
    "modification_flag", "payment_deferral_flag", "estimated_loan_to_value_eltv",
    "loan_age", "credit_score", "original_ltv", "original_cltv", "original_dti",
    "original_interest_rate", "original_loan_term", "original_upb",
    "number_of_borrowers", "loan_purpose", "property_type", "occupancy_status",
    "channel", "amortization_type", "number_of_units",
    *[f"max_dpd_{n}m" for n in history.ROLLING_MONTHS],
]


def prepare_origination(raw: DataFrame) -> DataFrame:
    """Canonical names, codes cleared, months as dates, padded postal code, trimmed key."""
    df = cleaning.clear_numeric_codes(cleaning.normalize_columns(raw), schema.ORIGINATION_NUMERIC_CODES)
    df = cleaning.parse_months(df, schema.ORIGINATION_MONTHS)
    if "postal_code3_trunc" in df.columns:
        df = df.withColumn("postal_code3_trunc", cleaning.pad_postal("postal_code3_trunc"))
    return df.withColumn(schema.LOAN, cleaning.join_key(schema.LOAN))


def prepare_performance(raw: DataFrame) -> DataFrame:
    df = cleaning.parse_months(cleaning.normalize_columns(raw), schema.PERFORMANCE_MONTHS)
    if "net_sale_proceeds" in df.columns:
        df = df.withColumn("net_sale_proceeds", cleaning.sale_proceeds("net_sale_proceeds"))
    return df.withColumn(schema.LOAN, cleaning.join_key(schema.LOAN))


def labelled_panel(
    performance: DataFrame, origination: DataFrame, rolling: bool = False,
    unique_loans: bool = False, calendar: bool = False, drop_censored: bool = False, trimmed: bool = False,
) -> DataFrame:
    """Panel with default columns and target: one exchange per input, both on the loan.

    Target and maxima look over rows or, with `calendar`, over months; `drop_censored` leaves out rows
    that are not followed for the whole horizon.  `trimmed` keys, as in tables stored in buckets, are taken as they are.
    """
    panel = joins.build_panel(performance, origination, unique_loans=unique_loans, trimmed=trimmed)
    key = F.col(schema.LOAN) if trimmed else cleaning.join_key(schema.LOAN)
    parents = None if unique_loans else origination.select(key.alias(schema.LOAN))
    return history.label_default(
        panel, rolling=history.ROLLING_MONTHS if rolling else (),
        skew_from=performance.withColumn(schema.LOAN, key), parents=parents,
        calendar=calendar, drop_censored=drop_censored,
    )


def quick_flags(performance: DataFrame) -> DataFrame:
    """Days late and the quick default flag of the exploratory tables."""
    return performance.withColumn(
        "dpd", delinquency.dpd_days("current_loan_delinquency_status")
    ).withColumn("default_flag_quick", delinquency.default_flag_quick("dpd", "zero_balance_code"))


def add_features(df: DataFrame) -> DataFrame:
    """Row features of the loan."""
    return df.withColumns({
        "spread_tasa": features.rate_spread(),
        "amortizacion_upb": features.upb_amortization(),
        "fue_modificado": features.yes_or_past("modification_flag"),
        "tiene_deferral": features.yes_or_past("payment_deferral_flag"),
        "estimated_loan_to_value_eltv": features.known_eltv(),
    })


def feature_dataset(
    panel: DataFrame, macro: DataFrame | None = None, levels: dict[str, list[str]] | None = None,
    encode: bool = True,
) -> DataFrame:
    """Modelling rows: look-back features, row features, macro columns, level codes.

    `panel` is a labelled panel; the delinquency maxima are added if it lacks them.
    Levels default to those found in the panel; without `encode` code columns stay text.
    """
    df = cleaning.select_present(panel, KEPT)
    if "max_dpd_3m" not in df.columns:
        df = history.rolling_max_dpd(df)
    df = joins.with_macro(add_features(df), macro)
    present = [c for c in schema.CATEGORICAL if c in df.columns]
    if encode:
        df = encode_levels(df, present, levels, fit_on=panel)
    return active(df.drop("modification_flag", "payment_deferral_flag"))


def model_rows(dataset: DataFrame) -> DataFrame:
    """Dataset with the out-of-time part's name and the target as a double label."""
    return dataset.withColumn("split", delinquency.split_name(schema.VINTAGE)).withColumn(
        "label", F.col(schema.TARGET).cast("double")
    )
