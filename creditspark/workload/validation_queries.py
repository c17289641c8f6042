"""Validation statistics on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.binning import quantile_bins
from creditspark.models import sicr
from creditspark.models.isotonic import calibrate, isotonic_blocks
from creditspark.models.training import best_model, fit_isotonic
from creditspark.operators import sampling, validation
from creditspark.operators.summaries import rows
from creditspark.workload import tables as t
from creditspark.workload.cleaning_queries import ID, LOAN_MONTH, SAMPLE_HASH
from creditspark.workload.panel_queries import _describe
from creditspark.workload.registry import query

DECILES = "[0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]"
BIN = "greatest(1, len(list_filter(list_distinct(e), lambda z: z < p)))"
EDGED = f"""
SELECT s.*, e.e FROM model_scores s
JOIN (SELECT model, quantile_cont(p, {DECILES}) AS e FROM model_scores GROUP BY 1) e ON s.model = e.model"""
BINNED = f"SELECT *, {BIN} AS bin FROM edged"


def _rounded(df, digits=6, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("quantile_bins", "SELECT obs_id, p, CAST(bin AS INTEGER) AS bin FROM binned WHERE model = 'plain'",
       edged=EDGED, binned=BINNED)
def _(spark, sf):
    return quantile_bins(t.scores(spark, sf), "p").select("obs_id", "p", "bin")


CUMULATIVE = """
SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY model) AS atp,
  sum(fp) OVER (PARTITION BY model) AS afp
FROM (SELECT model, p, sum(y) AS tp, sum(1 - y) AS fp FROM model_scores GROUP BY 1, 2)
WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""
DISCRIMINATION = """
SELECT model, CAST(sum((2 * ctp - tp) * fp) AS DOUBLE) / (2 * max(CAST(atp AS DOUBLE) * afp)) AS auc,
  greatest(0, max(CAST(ctp AS DOUBLE) / atp - CAST(cfp AS DOUBLE) / afp)) AS ks FROM cumulative GROUP BY 1"""


@query("auc_gini", "SELECT model, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini FROM discrimination",
       cumulative=CUMULATIVE, discrimination=DISCRIMINATION)
def _(spark, sf):
    out = validation.discrimination(t.model_scores(spark, sf), "y", "p", ["model"]).drop("ks")
    return _rounded(out, 9, "auc", "gini")


@query("ks", "SELECT model, round(ks, 9) AS ks FROM discrimination",
       cumulative=CUMULATIVE, discrimination=DISCRIMINATION)
def _(spark, sf):
    out = validation.discrimination(t.model_scores(spark, sf), "y", "p", ["model"])
    return _rounded(out.select("model", "ks"), 9, "ks")


@query("best_model", "SELECT arg_max(model, auc) AS model, round(max(auc), 9) AS auc FROM discrimination",
       cumulative=CUMULATIVE, discrimination=DISCRIMINATION)
def _(spark, sf):
    table = validation.discrimination(t.model_scores(spark, sf), "y", "p", ["model"])
    return _rounded(best_model(table, "auc"), 9, "auc")


@query("roc_curve", """
SELECT model, p AS threshold, CAST(cfp AS DOUBLE) / afp AS fpr, CAST(ctp AS DOUBLE) / atp AS tpr FROM cumulative""",
       cumulative=CUMULATIVE)
def _(spark, sf):
    return validation.roc_curve(t.model_scores(spark, sf), "y", "p", ["model"])


@query("brier", "SELECT model, round(avg((p - y) * (p - y)), 9) AS brier FROM model_scores GROUP BY 1")
def _(spark, sf):
    return _rounded(validation.brier(t.model_scores(spark, sf), "y", "p", ["model"]), 9, "brier")


@query("backtest_deciles", """
SELECT model, CAST(bin AS INTEGER) AS decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS defaults, round(avg(p), 9) AS pd_predicted,
  avg(y) AS pd_observed, round(avg(p) - avg(y), 9) AS difference FROM binned GROUP BY 1, 2""",
       edged=EDGED, binned=BINNED)
def _(spark, sf):
    table = validation.backtest_deciles(t.model_scores(spark, sf), "y", "p", ["model"])
    return _rounded(table, 9, "pd_predicted", "difference")


HL = """
SELECT model, sum((o - x) * (o - x) / nullif(x * (1 - x / n), 0)) AS hl
FROM (SELECT model, bin, count(*) AS n, sum(y) AS o, sum(p) AS x FROM binned GROUP BY 1, 2) GROUP BY 1"""
TAIL = "exp(-hl / 2) * (1 + hl / 2 + pow(hl / 2, 2) / 2 + pow(hl / 2, 3) / 6)"


@query("hosmer_lemeshow", f"SELECT model, round(hl, 6) AS hl, round({TAIL}, 9) AS p_value FROM hl_table",
       edged=EDGED, binned=BINNED, hl_table=HL)
def _(spark, sf):
    out = validation.hosmer_lemeshow(t.model_scores(spark, sf), "y", "p", ["model"])
    return out.withColumns({"hl": F.round("hl", 6), "p_value": F.round("p_value", 9)})


PSI = f"""
SELECT model, sum((q - r) * ln(q / r)) AS psi, CAST(sum(CASE WHEN nr = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_bins
FROM (
  SELECT model, b, nr, greatest(CAST(nr AS DOUBLE) / sum(nr) OVER (PARTITION BY model), 1e-6) AS r,
    greatest(CAST(nn AS DOUBLE) / sum(nn) OVER (PARTITION BY model), 1e-6) AS q
  FROM (
    SELECT g.model, g.b, count(CASE WHEN s.yr <= 1997 THEN 1 END) AS nr, count(CASE WHEN s.yr > 1997 THEN 1 END) AS nn
    FROM (SELECT model, unnest(range(10)) AS b FROM (SELECT DISTINCT model FROM model_scores)) g
    LEFT JOIN (
      SELECT m.model, m.yr, len(list_filter(e.e, lambda z: z <= m.p)) AS b FROM model_scores m
      JOIN (SELECT model, quantile_cont(p, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS e FROM model_scores
        WHERE yr <= 1997 GROUP BY 1) e ON m.model = e.model) s
    ON g.model = s.model AND g.b = s.b GROUP BY 1, 2)) GROUP BY 1"""


@query("psi", "SELECT model, round(psi, 9) AS psi, empty_bins FROM psi_table", psi_table=PSI)
def _(spark, sf):
    out = validation.psi(t.model_scores(spark, sf), "p", F.col("yr") <= 1997, ["model"])
    return _rounded(out, 9, "psi").withColumn("empty_bins", F.col("empty_bins").cast("long"))


@query("validation_report", f"""
SELECT d.model, round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini, round(ks, 9) AS ks, round(brier, 9) AS brier,
  round({TAIL}, 9) AS hl_p_value, round(psi, 9) AS psi,
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'monitor' ELSE 'unstable' END AS psi_status
FROM discrimination d JOIN hl_table h ON d.model = h.model JOIN psi_table s ON d.model = s.model
JOIN (SELECT model, avg((p - y) * (p - y)) AS brier FROM model_scores WHERE yr > 1997 GROUP BY 1) b ON d.model = b.model""",
       edged=EDGED.replace("FROM model_scores s", "FROM (SELECT * FROM model_scores WHERE yr > 1997) s").replace(
           "FROM model_scores GROUP", "FROM model_scores WHERE yr > 1997 GROUP"),
       binned=BINNED, hl_table=HL, cumulative=CUMULATIVE.replace("FROM model_scores GROUP", "FROM model_scores WHERE yr > 1997 GROUP"),
       discrimination=DISCRIMINATION, psi_table=PSI)
def _(spark, sf):
    out = validation.validation_report(
        t.model_scores(spark, sf), "y", "p", F.col("yr") <= 1997, ["model"])
    names = ["auc", "gini", "ks", "brier", "hl_p_value", "psi"]
    return _rounded(out, 9, *names).select("model", *names, "psi_status")


# --- calibration ------------------------------------------------------------


@query("calibrate_isotonic", """
SELECT a.p, round(max(a.low), 6) AS pd, any_value(a.n) AS n FROM (
  SELECT i.p, i.n, k.i, min((j.s - k.s + k.y) / (j.c - k.c + k.n)) AS low
  FROM iso i JOIN iso k ON k.i <= i.i JOIN iso j ON j.i >= i.i GROUP BY 1, 2, 3) a GROUP BY 1""",
       iso="""
SELECT p, y, n, row_number() OVER (ORDER BY p) AS i, CAST(sum(y) OVER (ORDER BY p) AS DOUBLE) AS s,
  sum(n) OVER (ORDER BY p) AS c
FROM (SELECT p, sum(y) AS y, count(*) AS n FROM score_sig_fx GROUP BY 1)""")
def _(spark, sf):
    df = t.scores(spark, sf, signal=True)
    fitted = fit_isotonic(df, "y", "p").transform(df)
    return _rounded(fitted.groupBy("p", "pd").agg(rows().alias("n")), 6, "pd")


ISO_FIT = """
SELECT a.p, max(a.low) AS pd, any_value(a.n) AS n FROM (
  SELECT i.p, i.n, k.i, min((j.s - k.s + k.y) / (j.c - k.c + k.n)) AS low
  FROM iso i JOIN iso k ON k.i <= i.i JOIN iso j ON j.i >= i.i GROUP BY 1, 2, 3) a GROUP BY 1"""
ISO = """
SELECT p, y, n, row_number() OVER (ORDER BY p) AS i, CAST(sum(y) OVER (ORDER BY p) AS DOUBLE) AS s,
  sum(n) OVER (ORDER BY p) AS c
FROM (SELECT p, sum(y) AS y, count(*) AS n FROM score_sig_fx WHERE yr <= 1996 GROUP BY 1)"""


def _earlier_blocks(spark, sf):
    return isotonic_blocks(t.scores(spark, sf, signal=True).filter("yr <= 1996"), "y", "p")


@query("isotonic_blocks", f"""
SELECT min(p) AS low, max(p) AS high, round(pd, 6) AS pd, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT p, n, round(pd, 9) AS pd FROM ({ISO_FIT})) GROUP BY pd""", iso=ISO)
def _(spark, sf):
    return _rounded(_earlier_blocks(spark, sf), 6, "pd")


@query("calibrate_later_scores", """
SELECT obs_id, s.p AS p, round(CASE WHEN a.p IS NULL THEN b.pd WHEN b.p IS NULL THEN a.pd
  ELSE a.pd + (b.pd - a.pd) * (s.p - a.p) / nullif(b.p - a.p, 0) END, 6) AS pd
FROM (SELECT obs_id, p FROM score_sig_fx WHERE yr > 1996) s
ASOF LEFT JOIN fit a ON s.p >= a.p ASOF LEFT JOIN fit b ON s.p < b.p""", iso=ISO, fit=ISO_FIT)
def _(spark, sf):
    later = t.scores(spark, sf, signal=True).filter("yr > 1996").select("obs_id", "p")
    return _rounded(calibrate(later, _earlier_blocks(spark, sf), "p"), 6, "pd")


# --- significant increase in credit risk ------------------------------------

FLAG = """CASE WHEN coalesce(pd_current / nullif(pd_origination, 0) > 2.5, false)
  OR coalesce(pd_current - pd_origination > 0.005, false) OR coalesce(dpd_numerico >= 1, false) THEN 1 ELSE 0 END"""
ASSESSED = f"""
SELECT *, CASE WHEN ifrs9_stage = 3 THEN 3 WHEN sicr_pd_flag = 1 THEN 2 ELSE 1 END AS ifrs9_stage_sicr
FROM (SELECT *, {FLAG} AS sicr_pd_flag FROM scored)"""


@query("sicr_flag", f"SELECT {LOAN_MONTH}, sicr_pd_flag FROM assessed", assessed=ASSESSED)
def _(spark, sf):
    return sicr.assess(t.with_scores(t.staged(spark, sf))).select(*ID, "sicr_pd_flag")


@query("sicr_stage", f"SELECT {LOAN_MONTH}, ifrs9_stage, ifrs9_stage_sicr FROM assessed", assessed=ASSESSED)
def _(spark, sf):
    return sicr.assess(t.with_scores(t.staged(spark, sf))).select(*ID, "ifrs9_stage", "ifrs9_stage_sicr")


@query("stage_reclassification", """
SELECT ifrs9_stage, ifrs9_stage_sicr, count(*) AS n FROM assessed GROUP BY 1, 2""", assessed=ASSESSED)
def _(spark, sf):
    return sicr.stage_reclassification(sicr.assess(t.with_scores(t.staged(spark, sf))))


@query("pd_summary", _describe("scored", ["pd_origination", "pd_current"], [0.25, 0.5, 0.75]))
def _(spark, sf):
    names = ["mean", "std", "p25", "p50", "p75"]
    return _rounded(sicr.pd_summary(t.with_scores(t.staged(spark, sf))), 6, *names)


@query("sicr_scatter_sample", f"""
SELECT {LOAN_MONTH}, pd_origination, pd_current, sicr_pd_flag FROM (
  SELECT *, row_number() OVER (ORDER BY {SAMPLE_HASH}) AS pos FROM assessed) WHERE pos <= 5000""", assessed=ASSESSED)
def _(spark, sf):
    assessed = sicr.assess(t.with_scores(t.staged(spark, sf)))
    known = assessed.dropna(subset=["pd_origination", "pd_current", "sicr_pd_flag"])
    return sampling.random_subsample(known, 5000, ID).select(
        *ID, "pd_origination", "pd_current", "sicr_pd_flag")


@query("riskiest_loan", f"""
SELECT 'highest' AS which, {LOAN_MONTH}, pd_current FROM (SELECT * FROM scored
  ORDER BY pd_current DESC, loan_sequence_number DESC, monthly_reporting_period DESC LIMIT 1)
UNION ALL SELECT 'lowest', {LOAN_MONTH}, pd_current FROM (SELECT * FROM scored
  ORDER BY pd_current, loan_sequence_number, monthly_reporting_period LIMIT 1)""")
def _(spark, sf):
    from creditspark.models.explain import extreme_loans

    return extreme_loans(t.with_scores(t.staged(spark, sf)), ID, "pd_current")
