"""Windows over the months of one loan: by rows, or by calendar months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning, delinquency
from creditspark.scale import calendar_max, entity_windows

# Columns that settle the order of repeated (loan, month) rows.
TIES = ("dpd_numerico", "evento_default")
ROLLING_MONTHS = (3, 6, 12)


def _ties(df: DataFrame) -> list[str]:
    return [c for c in TIES if c in df.columns]


def next_event(event: str, w: WindowSpec, horizon: int = schema.HORIZON) -> Column:
    """1 if the event happens in the next `horizon` rows, the current one excluded."""
    ahead = F.max(F.col(event).cast("int")).over(w.rowsBetween(1, horizon))
    return F.coalesce(ahead, F.lit(0))


def last_max(value: str, w: WindowSpec, rows: int) -> Column:
    """Largest known value of the last `rows` rows, the current one included."""
    return F.max(value).over(w.rowsBetween(1 - rows, Window.currentRow))


def _observed(w: WindowSpec, horizon: int) -> Column:
    """Whether the loan has a row `horizon` rows later."""
    return F.lead(F.lit(True), horizon, False).over(w)


def _event(event: str) -> Column:
    return F.col(event).cast("int")


def _calendar(
    df: DataFrame, key: str, month: str, event: str | None, value: str | None, horizon: int, name: str,
    months: Sequence[int], skew_from: DataFrame | None, drop_censored: bool,
) -> DataFrame:
    """Target and maxima over calendar months: a gap in a loan's months does not stretch the horizon."""
    wanted = {} if event is None else {name: (_event(event), 1, horizon)}
    wanted |= {f"max_dpd_{n}m": (F.col(value), 1 - n, 0) for n in months}
    if drop_censored:
        wanted["_observed"] = (F.lit(1), horizon, Window.unboundedFollowing)
    out = calendar_max(df, key, month, wanted, skew_from)
    if drop_censored:
        out = out.filter("_observed = 1").drop("_observed")
    known = F.col(month).isNotNull()
    columns = {f"max_dpd_{n}m": F.when(known, F.col(f"max_dpd_{n}m")).otherwise(F.col(value)) for n in months}
    return out.withColumns(columns | ({} if event is None else {name: F.coalesce(name, F.lit(0))}))


def lookahead_default(
    df: DataFrame, key: str = schema.LOAN, month: str = schema.MONTH,
    event: str = "evento_default", horizon: int = schema.HORIZON, name: str = schema.TARGET,
    skew_from: DataFrame | None = None, calendar: bool = False, drop_censored: bool = False,
) -> DataFrame:
    """Whether the loan defaults in its next `horizon` rows or, with `calendar`, months; later rows than those known count as none.

    With `drop_censored` rows that are not followed for the whole horizon are left out: the last `horizon` rows
    of a loan, or those less than `horizon` months before its last month.
    """
    if calendar:
        return _calendar(df, key, month, event, None, horizon, name, (), skew_from, drop_censored)

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {name: next_event(event, w, horizon)} | ({"_observed": _observed(w, horizon)} if drop_censored else {})

    out = entity_windows(df, key, month, columns, ahead=horizon, ties=_ties(df), skew_from=skew_from)
    return out.filter("_observed").drop("_observed") if drop_censored else out


def rolling_max_dpd(
    df: DataFrame, key: str = schema.LOAN, month: str = schema.MONTH,
    value: str = "dpd_numerico", rows: Sequence[int] = ROLLING_MONTHS,
    skew_from: DataFrame | None = None, calendar: bool = False,
) -> DataFrame:
    """Largest known delinquency of the last `rows` rows or, with `calendar`, months, the current one included."""
    if calendar:
        return _calendar(df, key, month, None, value, 0, "", rows, skew_from, False)
    return entity_windows(
        df, key, month, lambda w: {f"max_dpd_{n}m": last_max(value, w, n) for n in rows},
        behind=max(rows) - 1, ties=_ties(df), skew_from=skew_from,
    )


def default_columns(df: DataFrame) -> DataFrame:
    """Delinquency number, default event and stage; row expressions only."""
    return (
        df.withColumn("dpd_numerico", delinquency.dpd_numeric("current_loan_delinquency_status"))
        .withColumn("evento_default", delinquency.default_event("dpd_numerico", "zero_balance_code"))
        .withColumn("ifrs9_stage", delinquency.stage("dpd_numerico", "evento_default"))
    )


def label_default(
    panel: DataFrame, key: str = schema.LOAN, month: str = schema.MONTH,
    horizon: int = schema.HORIZON, rolling: Sequence[int] = (),
    skew_from: DataFrame | None = None, parents: DataFrame | None = None,
    calendar: bool = False, drop_censored: bool = False,
) -> DataFrame:
    """Panel + delinquency, event, stage and 12-month target.

    With `rolling`, the delinquency maxima are computed in the same pass, so one
    exchange and one sort serve all of them.  `parents` are the loans joined to the rows, if
    they may repeat a loan; `calendar` and `drop_censored` are those of `lookahead_default`.
    """
    staged = default_columns(panel)
    if calendar:
        return _calendar(staged, key, month, "evento_default", "dpd_numerico", horizon, schema.TARGET, rolling, skew_from, drop_censored)

    def columns(w: WindowSpec) -> dict[str, Column]:
        out = {schema.TARGET: next_event("evento_default", w, horizon)}
        out |= {"_observed": _observed(w, horizon)} if drop_censored else {}
        return out | {f"max_dpd_{n}m": last_max("dpd_numerico", w, n) for n in rolling}

    out = entity_windows(
        staged, key, month, columns, behind=max(rolling, default=1) - 1, ahead=horizon, ties=TIES,
        skew_from=skew_from, parents=parents,
    )
    return out.filter("_observed").drop("_observed") if drop_censored else out


def stage_after(
    df: DataFrame, rows: int, name: str, key: str = schema.LOAN, month: str = schema.MONTH,
    stage: str = "ifrs9_stage", skew_from: DataFrame | None = None, parents: DataFrame | None = None,
    calendar: bool = False,
) -> DataFrame:
    """Stage `rows` rows later; rows without one are dropped.

    With `calendar` the stage exactly `rows` months later, the highest if the loan repeats that month.
    """
    if calendar:
        moved = calendar_max(df, key, month, {name: (F.col(stage), rows, rows)}, skew_from)
        return moved.filter(F.col(name).isNotNull())
    moved = entity_windows(
        df, key, month, lambda w: {name: F.lead(stage, rows).over(w)},
        ahead=rows, ties=[c for c in (*TIES, stage) if c in df.columns], skew_from=skew_from, parents=parents,
    )
    return moved.filter(F.col(name).isNotNull())


def lag_features(
    df: DataFrame, key: str = "id_loan", month: str = "period",
    skew_from: DataFrame | None = None, distinct: bool = False, repeated: DataFrame | None | bool = True,
) -> DataFrame:
    """Values of the one or two earlier rows of the loan, with first-row defaults,
    and the status in which RA is replaced by the bucket it implies."""
    optional = "cur_dfrd_upb" in df.columns

    def columns(w: WindowSpec) -> dict[str, Column]:
        first = F.lag(F.lit(1), 1).over(w).isNull()
        back = lambda c, n=1: F.lag(c, n).over(w)
        out = {
            "prior_upb": F.when(first, F.lit(0.0)).otherwise(back("curr_act_upb")),
            "prior_int_rt": F.when(first, F.col("cur_int_rt")).otherwise(back("cur_int_rt")),
            "prior_delq_sts": F.when(first, F.lit("00")).otherwise(back("delq_sts")),
            "prior_delq_sts_2": F.when(first, F.lit("00")).otherwise(back("delq_sts", 2)),
            "prior_period": back(month),
        }
        if optional:
            out["prior_frb_upb"] = back("cur_dfrd_upb")
        return out

    lagged = entity_windows(
        df, key, month, columns, behind=2, ties=[c for c in ("delq_sts",) if c in df.columns],
        skew_from=skew_from, distinct=distinct, repeated=repeated,
    )
    return lagged.withColumn("period_diff", cleaning.months_between(month, "prior_period")).withColumn(
        "delq_sts_new", delinquency.recode_ra("delq_sts", "prior_delq_sts", "period_diff")
    )
