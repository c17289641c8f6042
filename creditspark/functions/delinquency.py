"""Delinquency, default and stage rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions.cleaning import number


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dpd_numeric(status: Column | str) -> Column:
    """Months late; RA counts as 99, other text is null."""
    status = _col(status)
    return F.when(status == "RA", F.lit(float(schema.RA_BUCKET))).otherwise(number(status))


def dpd_days(status: Column | str) -> Column:
    """Days late (30 per bucket, not below 0); null for any text status."""
    bucket = _col(status).try_cast("int")
    return F.when(bucket.isNotNull(), F.greatest(F.lit(0), bucket * 30))


def zero_balance(code: Column | str) -> Column:
    """Two-character code, whether it was read as text or as a number."""
    text = F.trim(_col(code).cast("string"))
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def default_event(
    dpd: Column | str, code: Column | str,
    bucket: int = schema.DEFAULT_BUCKET, codes: Sequence[str] = tuple(schema.DEFAULT_ZERO_BALANCE),
) -> Column:
    """Three months late or a loss code; unknown is false."""
    late = F.coalesce(_col(dpd) >= bucket, F.lit(False))
    loss = F.coalesce(zero_balance(code).isin(list(codes)), F.lit(False))
    return late | loss


def default_flag_quick(
    days: Column | str, code: Column | str,
    codes: Sequence[str] = tuple(schema.DEFAULT_ZERO_BALANCE),
) -> Column:
    """0/1 by three-valued OR: null when the days are unknown and there is no loss code."""
    loss = F.coalesce(zero_balance(code).isin(list(codes)), F.lit(False))
    return ((_col(days) >= 90) | loss).cast("int")


def stage(dpd: Column | str, in_default: Column | str) -> Column:
    """3 in default, 2 if one or two months late, else 1."""
    return (
        F.when(_col(in_default), F.lit(3)).when(_col(dpd).between(1, 2), F.lit(2)).otherwise(F.lit(1))
    )


# Labels of the delinquency mix.
DPD_BUCKETS = ["0", "30", "60", "3+", "unknown"]


def dpd_bucket(dpd: Column | str) -> Column:
    dpd = _col(dpd)
    return (
        F.when(dpd == 0, "0").when(dpd == 1, "30").when(dpd == 2, "60")
        .when(dpd >= 3, "3+").otherwise("unknown")
    )


def recode_ra(status: Column | str, prior: Column | str, gap: Column | str) -> Column:
    """Status with RA replaced by the bucket it implies one month after 5, 3 or 2."""
    status, prior, gap = _col(status), _col(prior), _col(gap)
    after = lambda bucket: (status == "RA") & (gap == 1) & (prior == bucket)
    return (
        F.when(status != "RA", status)
        .when(after("5"), "6").when(after("3"), "4").when(after("2"), "3")
    )


def psi_status(psi: Column | str) -> Column:
    psi = _col(psi)
    return (
        F.when(psi < schema.PSI_STABLE, "stable")
        .when(psi < schema.PSI_MONITOR, "monitor").otherwise("unstable")
    )


def split_name(vintage: Column | str) -> Column:
    """train / validation / test by vintage, null for any other year."""
    vintage = _col(vintage)
    return (
        F.when(vintage.isin(schema.TRAIN_VINTAGES), "train")
        .when(vintage.isin(schema.VALIDATION_VINTAGES), "validation")
        .when(vintage.isin(schema.TEST_VINTAGES), "test")
    )
