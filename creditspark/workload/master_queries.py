"""Loan master: lagged history, first events, terminal record, joined result."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import joins
from creditspark.plans import loan_master as lm
from creditspark.workload import tables as t
from creditspark.workload.registry import query


@query("svcg_detail", """
SELECT id_loan, period, curr_act_upb, delq_sts, cd_zero_bal, cur_int_rt, orig_upb FROM sas_detail""")
def _(spark, sf):
    detail = lm.history_detail(t.short_performance(spark, sf), t.short_origination(spark, sf))
    return detail.select("id_loan", "period", "curr_act_upb", "delq_sts", "cd_zero_bal", "cur_int_rt", "orig_upb")


@query("lag_features", """
SELECT id_loan, period, prior_upb, prior_int_rt, prior_delq_sts, prior_delq_sts_2, prior_period, period_diff
FROM sas_history""")
def _(spark, sf):
    return t.loan_history(spark, sf).select(
        "id_loan", "period", "prior_upb", "prior_int_rt", "prior_delq_sts", "prior_delq_sts_2",
        "prior_period", "period_diff")


@query("first_occurrence_join", """
SELECT h.id_loan, h.period, h.delq_sts, h.curr_act_upb FROM sas_history h JOIN (
  SELECT id_loan, min(period) AS period FROM sas_history WHERE delq_sts_new = '3' GROUP BY 1) f
ON h.id_loan = f.id_loan AND h.period = f.period WHERE h.delq_sts_new = '3'""")
def _(spark, sf):
    first = joins.first_occurrence(t.loan_history(spark, sf), F.col("delq_sts_new") == "3")
    return first.select("id_loan", "period", "delq_sts", "curr_act_upb")


@query("modified_loans_semi", """
SELECT id_loan, period, flag_mod, curr_act_upb FROM sas_detail
WHERE id_loan IN (SELECT id_loan FROM sas_detail WHERE flag_mod = 'Y')""")
def _(spark, sf):
    detail = lm.history_detail(t.short_performance(spark, sf), t.short_origination(spark, sf))
    return joins.rows_of_flagged_loans(detail, F.col("flag_mod") == "Y").select(
        "id_loan", "period", "flag_mod", "curr_act_upb")


@query("first_delinquency", "SELECT * FROM sas_balance")
def _(spark, sf):
    return lm.first_delinquency(t.loan_history(spark, sf))


@query("pre_d180_default", """
SELECT id_loan, period, delq_sts, cd_zero_bal, 1 AS pd_d180_ind,
  coalesce(nullif(curr_act_upb, 0), nullif(prior_upb, 0), orig_upb) AS pd_d180_upb FROM sas_d180""")
def _(spark, sf):
    return lm.pre_d180_default(t.loan_history(spark, sf))


@query("first_modification", """
SELECT id_loan, period, 1 AS mod_ind,
  coalesce(nullif(curr_act_upb, 0), nullif(prior_upb, 0), orig_upb) AS mod_upb FROM sas_mod""")
def _(spark, sf):
    return lm.first_modification(t.loan_history(spark, sf))


@query("terminal_record", """
SELECT id_loan, period, delq_sts, cd_zero_bal, curr_act_upb, prior_upb, default_upb, delq_string, month_string,
  current_int_rt, vintage FROM sas_terminal""")
def _(spark, sf):
    return lm.terminal_record(t.loan_history(spark, sf)).select(
        "id_loan", "period", "delq_sts", "cd_zero_bal", "curr_act_upb", "prior_upb", "default_upb",
        "delq_string", "month_string", "current_int_rt", "vintage")


@query("default_record", """
SELECT id_loan, period, cd_zero_bal, dflt_delq_sts, acqn_to_dispn,
  CASE WHEN TRY_CAST(dflt_delq_sts AS DOUBLE) IS NOT NULL OR acqn_to_dispn IS NOT NULL
    THEN coalesce(TRY_CAST(dflt_delq_sts AS DOUBLE), 0) + coalesce(acqn_to_dispn, 0) END AS mths_dlq_dflt_dispn,
  coalesce(TRY_CAST(dflt_delq_sts AS DOUBLE), 0) AS mths_dlq_dflt_acqn
FROM (
  SELECT *,
    CASE WHEN cd_zero_bal IN ('02', '03', '15') THEN delq_sts
      WHEN coalesce(prior_delq_sts = 'RA', false) THEN prior_delq_sts_2 ELSE prior_delq_sts END AS dflt_delq_sts,
    CASE WHEN cd_zero_bal = '09' THEN CASE WHEN coalesce(prior_delq_sts = 'RA', false) THEN period_diff ELSE 0 END END
      AS acqn_to_dispn
  FROM sas_terminal WHERE cd_zero_bal IN ('02', '03', '09', '15'))""")
def _(spark, sf):
    return lm.default_record(lm.terminal_record(t.loan_history(spark, sf))).select(
        "id_loan", "period", "cd_zero_bal", "dflt_delq_sts", "acqn_to_dispn", "mths_dlq_dflt_dispn",
        "mths_dlq_dflt_acqn")


OUTCOMES = """CASE WHEN f.cd_zero_bal IN ('01', '96') THEN 1 END AS prepay_count,
  CASE WHEN f.cd_zero_bal IN ('02', '03', '09', '15') THEN 1 END AS default_count,
  CASE WHEN f.cd_zero_bal IN ('01', '96') THEN f.prior_upb END AS prepay_upb,
  CASE WHEN f.cd_zero_bal IS NULL THEN f.curr_act_upb END AS rmng_upb"""


@query("termination_outcomes", f"SELECT id_loan, {OUTCOMES} FROM sas_terminal f")
def _(spark, sf):
    terminal = lm.terminal_record(t.loan_history(spark, sf))
    return terminal.select("id_loan", *[c.alias(n) for n, c in lm.outcome_columns().items()])


EVER = ", ".join(
    f"a{b}.dlq_ind AS dlq_{n}_ind, a{b}.dlq_upb AS dlq_{n}_upb" for b, n in lm.EVER_NAMES.items())
EVER_JOINS = "\n".join(
    f"LEFT JOIN sas_balance a{b} ON a{b}.bucket = {b} AND o.id_loan = a{b}.id_loan" for b in lm.EVER_NAMES)


@query("loan_master", f"""
SELECT o.id_loan, o.fico, o.orig_upb, f.current_int_rt, f.cd_zero_bal, f.delq_sts AS zero_bal_delq_sts,
  f.net_sale_proceeds, {EVER}, {OUTCOMES},
  CASE WHEN m.id_loan IS NOT NULL THEN 1 END AS mod_ind,
  coalesce(nullif(m.curr_act_upb, 0), nullif(m.prior_upb, 0), m.orig_upb) AS mod_upb,
  CASE WHEN n.id_loan IS NOT NULL THEN 1 END AS pd_d180_ind,
  coalesce(nullif(n.curr_act_upb, 0), nullif(n.prior_upb, 0), n.orig_upb) AS pd_d180_upb
FROM (SELECT trim(loan_sequence_number) AS id_loan, credit_score AS fico, original_upb AS orig_upb FROM orig_fx) o
LEFT JOIN sas_terminal f ON o.id_loan = f.id_loan
{EVER_JOINS}
LEFT JOIN sas_mod m ON o.id_loan = m.id_loan
LEFT JOIN sas_d180 n ON o.id_loan = n.id_loan""")
def _(spark, sf):
    loans = t.short_origination(spark, sf).select("id_loan", "fico", "orig_upb")
    return lm.loan_master(t.short_performance(spark, sf), loans)
