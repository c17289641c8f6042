"""Discrimination, calibration and stability statistics of scored rows.

Every function takes the outcome column `y` (0/1), the score column `p` and an
optional list `by` (for example the model name), and returns DataFrames.  The rows
are read once and tallied per distinct score; everything else is computed from
those tallies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.binning import quantile_bins, quantile_edges, reference_bin
from creditspark.functions.delinquency import psi_status
from creditspark.scale import attach, cut, join_on, running_totals


def tally(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows `n` and positives `pos` per distinct known score."""
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*by, p).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")
    )


def score_table(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score with running sums from the top score."""
    return _ranked(tally(df, y, p, by), p, by)


def _ranked(tallies: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    split = tallies.select(*by, p, F.col("pos").alias("tp"), (F.col("n") - F.col("pos")).alias("fp"))
    return running_totals(split, p, ["tp", "fp"], by, descending=True)


def _metrics(tallies: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    tp, fp, score = F.col("cum_tp"), F.col("cum_fp"), F.col(p)
    # Twice the area keeps every term a whole number.
    area = F.sum((2 * tp - F.col("tp")).cast("double") * F.col("fp"))
    pairs = F.max(F.col("all_tp").cast("double") * F.col("all_fp"))
    gap = F.try_divide(tp.cast("double"), F.col("all_tp")) - F.try_divide(fp.cast("double"), F.col("all_fp"))
    square = F.col("tp") * (score - 1) * (score - 1) + F.col("fp") * score * score
    found = _ranked(tallies, p, by).groupBy(*by).agg(
        F.try_divide(area, pairs * 2).alias("auc"), F.greatest(F.max(gap), F.lit(0.0)).alias("ks"),
        (F.sum(square) / F.sum(F.col("tp") + F.col("fp"))).alias("brier"),
        F.max("all_tp").alias("defaults"), F.max("all_fp").alias("no_defaults"),
    )
    rows = F.col("defaults") + F.col("no_defaults")
    return found.select(
        *by, "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "brier", "defaults", "no_defaults",
        F.try_divide(F.col("defaults").cast("double"), rows).alias("default_rate"),
    )


def basic_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini, KS, Brier and class counts per group."""
    return _metrics(tally(df, y, p, by), p, by)


def discrimination(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC with half credit for ties, Gini and KS."""
    return basic_metrics(df, y, p, by).select(*by, "auc", "gini", "ks")


def roc_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """FPR and TPR at every distinct score taken as threshold."""
    return score_table(df, y, p, by).select(
        *by, F.col(p).alias("threshold"),
        F.try_divide(F.col("cum_fp").cast("double"), F.col("all_fp")).alias("fpr"),
        F.try_divide(F.col("cum_tp").cast("double"), F.col("all_tp")).alias("tpr"),
    )


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def _binned(tallies: DataFrame, p: str, by: Sequence[str], q: int) -> DataFrame:
    """Per quantile bin rows, positives and summed score."""
    return quantile_bins(tallies, p, q, by, "decile", frequency="n").groupBy(*by, "decile").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("defaults"), F.sum(F.col(p) * F.col("n")).alias("expected")
    )


def backtest_deciles(df: DataFrame, y: str, p: str, by: Sequence[str] = (), q: int = 10) -> DataFrame:
    """Predicted against observed rate per score decile."""
    rates = _binned(tally(df, y, p, by), p, by, q).withColumns({
        "pd_predicted": F.col("expected") / F.col("n"), "pd_observed": F.col("defaults") / F.col("n"),
    })
    return rates.withColumn("difference", F.col("pd_predicted") - F.col("pd_observed")).drop("expected")


def chi2_survival_even(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution for an even number of degrees."""
    if df % 2 or df < 2:
        raise ValueError("degrees of freedom must be even")
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def hosmer_lemeshow(df: DataFrame, y: str, p: str, by: Sequence[str] = (), q: int = 10) -> DataFrame:
    """Statistic and p-value; q - 2 degrees of freedom even if tied bins collapsed."""
    return _hosmer_lemeshow(tally(df, y, p, by), p, by, q)


def _hosmer_lemeshow(tallies: DataFrame, p: str, by: Sequence[str], q: int) -> DataFrame:
    gap = F.col("defaults") - F.col("expected")
    spread = F.col("expected") * (1 - F.try_divide(F.col("expected"), F.col("n")))
    return (
        _binned(tallies, p, by, q).groupBy(*by)
        .agg(F.sum(F.try_divide(gap * gap, spread)).alias("hl"))
        .withColumn("p_value", chi2_survival_even(F.col("hl"), q - 2))
    )


def psi(
    df: DataFrame, p: str, is_reference: Column, by: Sequence[str] = (), q: int = 10,
) -> DataFrame:
    """Stability index of all rows that are not reference against those that are.

    Bins come from the reference quantiles; tied edges leave empty bins, which count
    with the floor share and are reported.
    """
    flagged = df.filter(F.col(p).isNotNull()).withColumn("_ref", is_reference)
    return _psi(flagged.groupBy(*by, "_ref", p).agg(F.count(F.lit(1)).alias("n")), p, by, q)


def _psi(tallies: DataFrame, p: str, by: Sequence[str], q: int) -> DataFrame:
    edges = quantile_edges(tallies.filter("_ref"), p, q, by, frequency="n")
    binned = attach(tallies, edges, by).withColumn("_bin", reference_bin(F.col(p), F.col("_edges"), q))
    ref, new = F.col("_ref"), ~F.col("_ref")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = binned.groupBy(*by).agg(
        *[total(ref & (F.col("_bin") == b)).alias(f"r{b}") for b in range(q)],
        *[total(new & (F.col("_bin") == b)).alias(f"n{b}") for b in range(q)],
        total(ref).alias("n_ref"), total(new).alias("n_new"),
    )

    def floor_share(count: str, whole: str) -> Column:
        return F.greatest(F.try_divide(F.col(count).cast("double"), F.col(whole)), F.lit(1e-6))

    terms, empty = [], []
    for b in range(q):
        before, after = floor_share(f"r{b}", "n_ref"), floor_share(f"n{b}", "n_new")
        terms.append((after - before) * F.log(after / before))
        empty.append((F.col(f"r{b}") == 0).cast("int"))
    return counts.select(
        *by, sum(terms[1:], terms[0]).alias("psi"), sum(empty[1:], empty[0]).alias("empty_bins")
    )


def validation_report(
    df: DataFrame, y: str, p: str, is_reference: Column, by: Sequence[str], q: int = 10,
) -> DataFrame:
    """One row per model: metrics of the new rows, stability against the reference rows."""
    tallies = cut(tally(df.withColumn("_ref", is_reference), y, p, [*by, "_ref"]))  # three tables read them
    new = tallies.filter(~F.col("_ref"))
    report = _metrics(new, p, by).select(*by, "auc", "gini", "ks", "brier")
    for table in (
        _hosmer_lemeshow(new, p, by, q).withColumnRenamed("p_value", "hl_p_value"),
        _psi(tallies, p, by, q),
    ):
        report = join_on(report, table, by)
    return report.withColumn("psi_status", psi_status("psi"))
