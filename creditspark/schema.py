"""Table layouts, not-available codes and model constants.

Everything in this file is a fixed value: the public loan-level file layout,
its code lists, and the parameters the results depend on.
"""

from __future__ import annotations

from pyspark.sql import types as T

LOAN = "loan_sequence_number"
MONTH = "monthly_reporting_period"
VINTAGE = "vintage_year"
TARGET = "default_12m"

# Origination file, 32 positional fields.
ORIGINATION_FIELDS = [
    "credit_score", "first_payment_date", "first_time_homebuyer_flag", "maturity_date",
    "msa_md_code", "mi_percent", "number_of_units", "occupancy_status",
    "original_cltv", "original_dti", "original_upb", "original_ltv",
    "original_interest_rate", "channel", "prepayment_penalty_flag", "amortization_type",
    "property_state", "property_type", "postal_code3_trunc", "loan_sequence_number",
    "loan_purpose", "original_loan_term", "number_of_borrowers", "seller_name",
    "servicer_name", "super_conforming_flag", "pre_relief_refi_loan_seq_num",
    "special_eligibility_program", "relief_refinance_indicator", "property_valuation_method",
    "interest_only_indicator", "mi_cancellation_indicator",
]

# Monthly performance file, 32 positional fields.
PERFORMANCE_FIELDS = [
    "loan_sequence_number", "monthly_reporting_period", "current_actual_upb",
    "current_loan_delinquency_status", "loan_age", "remaining_months_to_legal_maturity",
    "defect_settlement_date", "modification_flag", "zero_balance_code",
    "zero_balance_effective_date", "current_interest_rate",
    "current_non_interest_bearing_upb", "ddlpi_due_date_last_paid_installment",
    "mi_recoveries", "net_sale_proceeds", "non_mi_recoveries", "total_expenses",
    "legal_costs", "maintenance_preservation_costs", "taxes_and_insurance",
    "misc_expenses", "actual_loss_calculation", "cumulative_modification_cost",
    "step_modification_flag", "payment_deferral_flag", "estimated_loan_to_value_eltv",
    "zero_balance_removal_upb", "delinquent_accrued_interest",
    "delinquency_due_to_disaster_flag", "borrower_assistance_status_code",
    "current_month_modification_cost", "interest_bearing_upb",
]

# Short names of the quarterly file layout, by the same positions.
ORIGINATION_SHORT_NAMES = [
    "fico", "dt_first_pi", "flag_fthb", "dt_matr", "cd_msa", "mi_pct", "cnt_units",
    "occpy_sts", "cltv", "dti", "orig_upb", "ltv", "orig_int_rt", "channel", "ppmt_pnlty",
    "amrtzn_type", "st", "prop_type", "zipcode", "id_loan", "loan_purpose",
    "orig_loan_term", "cnt_borr", "seller_name", "servicer_name", "flag_sc",
    "id_loan_preharp", "ind_afdl", "ind_harp", "cd_ppty_val_type", "flag_int_only",
    "ind_mi_cncl",
]
PERFORMANCE_SHORT_NAMES = [
    "id_loan", "period", "curr_act_upb", "delq_sts", "loan_age", "mths_remng",
    "dt_dfct_setlmt", "flag_mod", "cd_zero_bal", "dt_zero_bal", "cur_int_rt",
    "cur_dfrd_upb", "dt_lst_pi", "mi_recoveries", "net_sale_proceeds",
    "non_mi_recoveries", "expenses", "legal_costs", "maint_pres_costs",
    "taxes_ins_costs", "misc_costs", "actual_loss", "modcost", "stepmod_ind",
    "dpm_ind", "eltv", "zb_removal_upb", "dlq_acrd_int", "disaster_area_flag",
    "borr_assist_ind", "monthly_modcost", "amt_int_brng_upb",
]

# Codes that mean "not available", as text.
ORIGINATION_CODES = {
    "credit_score": ["9999"],
    "mi_percent": ["999"],
    "number_of_units": ["99"],
    "occupancy_status": ["9"],
    "original_cltv": ["999"],
    "original_dti": ["999"],
    "original_ltv": ["999"],
    "channel": ["9"],
    "property_type": ["99"],
    "number_of_borrowers": ["99"],
    "property_valuation_method": ["9"],
    "special_eligibility_program": ["9"],
    "mi_cancellation_indicator": ["9"],
    "loan_purpose": ["9"],
}
PERFORMANCE_CODES = {
    "estimated_loan_to_value_eltv": ["999"],
    "net_sale_proceeds": ["U"],
}
# The same for columns that are already numbers.
ORIGINATION_NUMERIC_CODES = {
    "credit_score": 9999,
    "mi_percent": 999,
    "number_of_units": 99,
    "original_cltv": 999,
    "original_dti": 999,
    "original_ltv": 999,
    "number_of_borrowers": 99,
    "property_valuation_method": 9,
}
# Null spellings of the inferring reader.
NULL_TOKENS = ["", "NA", "NaN", "NULL"]

# Columns cast to double after the codes are cleared.
ORIGINATION_NUMERIC = [
    "credit_score", "msa_md_code", "mi_percent", "number_of_units", "original_cltv",
    "original_dti", "original_upb", "original_ltv", "original_interest_rate",
    "original_loan_term", "number_of_borrowers", "property_valuation_method",
]
PERFORMANCE_NUMERIC = [
    "current_actual_upb", "loan_age", "remaining_months_to_legal_maturity",
    "current_interest_rate", "current_non_interest_bearing_upb", "mi_recoveries",
    "non_mi_recoveries", "total_expenses", "legal_costs",
    "maintenance_preservation_costs", "taxes_and_insurance", "misc_expenses",
    "actual_loss_calculation", "cumulative_modification_cost",
    "estimated_loan_to_value_eltv", "zero_balance_removal_upb",
    "delinquent_accrued_interest", "current_month_modification_cost",
    "interest_bearing_upb",
]
ORIGINATION_MONTHS = ["first_payment_date", "maturity_date"]
PERFORMANCE_MONTHS = [
    "monthly_reporting_period", "zero_balance_effective_date", "defect_settlement_date",
    "ddlpi_due_date_last_paid_installment",
]

# Default definition.
DEFAULT_BUCKET = 3
HORIZON = 12
RA_BUCKET = 99
DEFAULT_ZERO_BALANCE = ["02", "03", "09"]
DISPOSITION_ZERO_BALANCE = ["02", "03", "09", "15"]
PRE_D180_ZERO_BALANCE = ["02", "03", "15"]
PREPAY_ZERO_BALANCE = ["01", "96"]
FIRST_DELINQUENCY_BUCKETS = [1, 2, 3, 4, 6]

# Out-of-time split by vintage (there is no 2021).
TRAIN_VINTAGES = [2016, 2017, 2018, 2019, 2020]
VALIDATION_VINTAGES = [2022, 2023]
TEST_VINTAGES = [2024]

# Model features.
ORIGINATION_FEATURES = [
    "credit_score", "original_ltv", "original_cltv", "original_dti",
    "original_interest_rate", "original_loan_term", "original_upb",
    "number_of_borrowers", "loan_purpose", "property_type", "occupancy_status",
    "channel", "number_of_units",
]
BEHAVIOUR_FEATURES = [
    "loan_age", "current_interest_rate", "current_actual_upb",
    "estimated_loan_to_value_eltv", "dpd_numerico", "max_dpd_3m", "max_dpd_6m",
    "max_dpd_12m", "fue_modificado", "tiene_deferral", "spread_tasa",
    "amortizacion_upb",
]
MACRO_FEATURES = [
    "hpi", "unemployment_rate", "fed_funds_rate", "gdp_real", "mortgage_rate_30y",
    "hpi_yoy_change", "unemployment_yoy_change",
]
MODEL_FEATURES = ORIGINATION_FEATURES + BEHAVIOUR_FEATURES + MACRO_FEATURES
CATEGORICAL = [
    "loan_purpose", "property_type", "occupancy_status", "channel", "amortization_type",
]

# Macro series and how each one becomes monthly.
MACRO_SERIES = {
    "USSTHPI": "hpi",
    "UNRATE": "unemployment_rate",
    "FEDFUNDS": "fed_funds_rate",
    "GDPC1": "gdp_real",
    "MORTGAGE30US": "mortgage_rate_30y",
}
QUARTERLY_SERIES = ["USSTHPI", "GDPC1"]
WEEKLY_SERIES = ["MORTGAGE30US"]

# Scenarios (weight, HPI factor, unemployment shift, Fed funds shift).
SCENARIOS = {
    "base": (0.50, 1.00, 0.0, 0.0),
    "pessimistic": (0.30, 0.75, 4.0, -2.5),
    "optimistic": (0.20, 1.02, -1.0, 0.0),
}

# Significant increase in credit risk.
SICR_RATIO = 2.5
SICR_DIFFERENCE = 0.005

# Stability index limits.
PSI_STABLE = 0.1
PSI_MONITOR = 0.25


def text_schema(fields: list[str]) -> T.StructType:
    """Every field a nullable string, in file order."""
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def short_name_map() -> dict[str, str]:
    """Short layout name -> canonical name, for both files."""
    return dict(zip(PERFORMANCE_SHORT_NAMES, PERFORMANCE_FIELDS)) | dict(
        zip(ORIGINATION_SHORT_NAMES, ORIGINATION_FIELDS)
    )
