"""Loan master: one row per loan with its first delinquencies, modification, default
and terminal record.

All of these are per-loan picks from the same ordered history, so they are one
conditional aggregate per loan and one join with origination.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning
from creditspark.functions.delinquency import zero_balance
from creditspark.operators.history import lag_features
from creditspark.scale import bounded, join_on, repeated_keys, row_hash

# Terminal-record columns that are passed through when present.
CARRIED = [
    "cd_zero_bal", "dt_zero_bal", "dt_dfct_setlmt", "expenses", "mi_recoveries",
    "non_mi_recoveries", "net_sale_proceeds", "actual_loss", "legal_costs",
    "taxes_ins_costs", "maint_pres_costs", "misc_costs", "modcost", "dt_lst_pi",
    "zb_removal_upb", "dlq_acrd_int",
]
# Output names of the ever-delinquent columns by bucket.
EVER_NAMES = {1: "ever30", 2: "ever60", 3: "everd90", 4: "everd120", 6: "everd180"}


def short_names(df: DataFrame) -> DataFrame:
    """Canonical names -> the short names used here."""
    names = {v: k for k, v in schema.short_name_map().items()}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def history_detail(performance: DataFrame, origination: DataFrame) -> DataFrame:
    """Distinct performance rows of known loans with the original balance."""
    loans = origination.select("id_loan", "orig_upb")
    return performance.join(loans, "id_loan").distinct()


def loss_code(codes: Sequence[str], column: str = "cd_zero_bal") -> Column:
    return F.coalesce(zero_balance(column).isin(list(codes)), F.lit(False))


def is_pre_d180() -> Column:
    """Bucket 6, or a loss code / RA while the known bucket is below 6.

    An RA status without an implied bucket is unknown and counts as below 6.
    """
    bucket = cleaning.number("delq_sts_new")
    early = loss_code(schema.PRE_D180_ZERO_BALANCE) | F.coalesce(F.col("delq_sts") == "RA", F.lit(False))
    at_d180 = F.coalesce(F.col("delq_sts_new") == "6", F.lit(False))
    return at_d180 | (early & ~F.coalesce(bucket >= 6, F.lit(False)))


def balance(*before: str, last: str = "orig_upb") -> Column:
    """First known non-zero balance, else the original one."""
    return cleaning.fallback(*[F.col(c) for c in before], F.col(last))


def _place(history: DataFrame, month: str, fixed: bool) -> Column:
    """Order of a loan's rows: month, then status, and for loans with repeats a hash of the whole row."""
    last = [row_hash(history).alias("_h")] if fixed else []
    return F.struct(month, *[c for c in ("delq_sts",) if c in history.columns], *last)


def _first(condition: Column, fields: Sequence[str], place: Column) -> Column:
    return F.min_by(F.struct(*fields), F.when(condition, place))


def _per_loan(
    history: DataFrame, key: str, month: str, pick: Callable[[DataFrame, Column], DataFrame],
    repeated: DataFrame | None | bool = True,
) -> DataFrame:
    """Picks per loan by place; the whole row is read only for loans with rows that month and status do not tell apart."""
    if repeated is True:
        repeated = repeated_keys(history, key, month, ("delq_sts",))
    if repeated is None:
        return pick(history, _place(history, month, False))
    keys = bounded(repeated)
    plain, others = join_on(history, keys, [key], "left_anti"), join_on(history, keys, [key], "left_semi")
    return pick(plain, _place(plain, month, False)).unionByName(pick(others, _place(others, month, True)))


def first_delinquency(history: DataFrame, key: str = "id_loan", month: str = "period") -> DataFrame:
    """Per loan and bucket the first month in exactly that bucket, with its balance."""
    fields = [month, "curr_act_upb", "prior_upb", "orig_upb"]
    buckets = schema.FIRST_DELINQUENCY_BUCKETS
    per_loan = _per_loan(history, key, month, lambda rows, place: rows.groupBy(key).agg(*[
        _first(F.col("delq_sts_new") == str(b), fields, place).alias(f"b{b}") for b in buckets
    ]))
    long = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}").alias("r")) for b in buckets
    ]))
    return (
        per_loan.select(key, long.alias("_x")).select(key, "_x.bucket", "_x.r.*")
        .filter(F.col(month).isNotNull())
        .select(key, "bucket", month, F.lit(1).alias("dlq_ind"),
                balance("curr_act_upb", "prior_upb").alias("dlq_upb"))
    )


def pre_d180_default(history: DataFrame, key: str = "id_loan", month: str = "period") -> DataFrame:
    """First bucket-6 month or earlier default per loan."""
    fields = [month, "curr_act_upb", "prior_upb", "orig_upb", "delq_sts", "cd_zero_bal"]
    first = _per_loan(history.filter(is_pre_d180()), key, month, lambda rows, place: rows.groupBy(key).agg(
        F.min_by(F.struct(*fields), place).alias("r")))
    return first.select(key, "r.*").select(
        key, month, "delq_sts", "cd_zero_bal", F.lit(1).alias("pd_d180_ind"),
        balance("curr_act_upb", "prior_upb").alias("pd_d180_upb"),
    )


def first_modification(history: DataFrame, key: str = "id_loan", month: str = "period") -> DataFrame:
    """First month with a current modification per loan, with its balance."""
    fields = [month, "curr_act_upb", "prior_upb", "orig_upb"]
    first = _per_loan(history.filter(F.col("flag_mod") == "Y"), key, month, lambda rows, place: rows.groupBy(key).agg(
        F.min_by(F.struct(*fields), place).alias("r")))
    return first.select(key, "r.*").select(
        key, month, F.lit(1).alias("mod_ind"), balance("curr_act_upb", "prior_upb").alias("mod_upb")
    )


def _terminal_columns() -> dict[str, Column]:
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    return {
        "default_upb": F.when(
            loss_code(schema.DISPOSITION_ZERO_BALANCE), balance("curr_act_upb", "prior_upb")
        ),
        "delq_string": F.concat_ws(" to ", text("prior_delq_sts", ""), text("delq_sts", "")),
        "month_string": F.concat_ws(" to ", text("prior_period", "."), text("period", ".")),
        "current_int_rt": cleaning.fallback(F.col("cur_int_rt"), F.col("prior_int_rt")),
        "vintage": cleaning.loan_id_vintage("id_loan"),
    }


def terminal_record(history: DataFrame, key: str = "id_loan", month: str = "period") -> DataFrame:
    """Last row of every loan with its default balance, transition texts and rate."""
    fields = [c for c in history.columns if c not in (key, month)]
    last = _per_loan(history, key, month, lambda rows, place: rows.groupBy(key).agg(
        F.max_by(F.struct(month, *fields), place).alias("r")))
    return last.select(key, "r.*").withColumns(_terminal_columns())


def default_record(terminal: DataFrame) -> DataFrame:
    """Terminal rows with a disposition code: status at default and months delinquent."""
    code = zero_balance("cd_zero_bal")
    prior, prior2 = F.col("prior_delq_sts"), F.col("prior_delq_sts_2")
    prior_is_ra = F.coalesce(prior == "RA", F.lit(False))
    status = F.when(code.isin(schema.PRE_D180_ZERO_BALANCE), F.col("delq_sts")).otherwise(
        F.when(prior_is_ra, prior2).otherwise(prior)
    )
    to_sale = F.when(
        code == "09", F.when(prior_is_ra, F.col("period_diff")).otherwise(F.lit(0))
    )
    months = cleaning.number("dflt_delq_sts")
    known_sum = F.when(
        months.isNotNull() | F.col("acqn_to_dispn").isNotNull(),
        F.coalesce(months, F.lit(0.0)) + F.coalesce("acqn_to_dispn", F.lit(0)),
    )
    extra = {"frb_upb": F.col("prior_frb_upb")} if "prior_frb_upb" in terminal.columns else {}
    return (
        terminal.filter(loss_code(schema.DISPOSITION_ZERO_BALANCE))
        .withColumns({"dflt_delq_sts": status, "acqn_to_dispn": to_sale} | extra)
        .withColumns({
            "mths_dlq_dflt_dispn": known_sum,
            "mths_dlq_dflt_acqn": F.coalesce(months, F.lit(0.0)),
        })
    )


def outcome_columns(code: str = "cd_zero_bal") -> dict[str, Column]:
    """Prepayment and default counts and balances of a terminal row."""
    prepaid = loss_code(schema.PREPAY_ZERO_BALANCE, code)
    return {
        "prepay_count": F.when(prepaid, F.lit(1)),
        "default_count": F.when(loss_code(schema.DISPOSITION_ZERO_BALANCE, code), F.lit(1)),
        "prepay_upb": F.when(prepaid, F.col("prior_upb")),
        "rmng_upb": F.when(F.col(code).isNull(), F.col("curr_act_upb")),
    }


def loan_master(performance: DataFrame, origination: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per origination loan, in short names.

    Performance is deduplicated and lagged, aggregated once per loan, and joined with
    origination; the original balance enters after the join, as it is a loan column.
    """
    repeated = repeated_keys(performance, "id_loan", "period", ("delq_sts",))
    history = lag_features(performance, distinct=distinct, repeated=repeated)
    month, fields = "period", ["curr_act_upb", "prior_upb"]
    carried = [c for c in CARRIED if c in history.columns]
    last = [
        "period", "delq_sts", "curr_act_upb", "prior_upb", "cur_int_rt", "prior_int_rt",
        "prior_delq_sts", "prior_period", *carried,
    ]
    firsts = {
        **{f"b{b}": F.col("delq_sts_new") == str(b) for b in schema.FIRST_DELINQUENCY_BUCKETS},
        "mod": F.col("flag_mod") == "Y",
        "d180": is_pre_d180(),
    }
    per_loan = _per_loan(history, "id_loan", month, lambda rows, place: rows.groupBy("id_loan").agg(
        F.max_by(F.struct(*last), place).alias("f"),
        *[_first(c, [month, *fields], place).alias(n) for n, c in firsts.items()],
    ), repeated)
    joined = origination.join(per_loan, "id_loan", "left")

    def pick(name: str, ind: str, upb: str) -> dict[str, Column]:
        found = F.col(name).isNotNull()
        amount = cleaning.fallback(
            F.col(f"{name}.curr_act_upb"), F.col(f"{name}.prior_upb"), F.col("orig_upb")
        )
        return {ind: F.when(found, F.lit(1)), upb: F.when(found, amount)}

    renamed = {"dt_zero_bal": "zero_bal_period"}
    out = {
        "current_int_rt": cleaning.fallback(F.col("f.cur_int_rt"), F.col("f.prior_int_rt")),
        "zero_bal_delq_sts": F.col("f.delq_sts"),
        **{renamed.get(c, c): F.col(f"f.{c}") for c in carried},
        # Outcomes read the terminal row.
        "prepay_count": F.when(loss_code(schema.PREPAY_ZERO_BALANCE, "f.cd_zero_bal"), F.lit(1)),
        "default_count": F.when(loss_code(schema.DISPOSITION_ZERO_BALANCE, "f.cd_zero_bal"), F.lit(1)),
        "prepay_upb": F.when(loss_code(schema.PREPAY_ZERO_BALANCE, "f.cd_zero_bal"), F.col("f.prior_upb")),
        "rmng_upb": F.when(F.col("f.cd_zero_bal").isNull(), F.col("f.curr_act_upb")),
    }
    for b, name in EVER_NAMES.items():
        out |= pick(f"b{b}", f"dlq_{name}_ind", f"dlq_{name}_upb")
    out |= pick("mod", "mod_ind", "mod_upb") | pick("d180", "pd_d180_ind", "pd_d180_upb")
    return joined.select(*origination.columns, *[c.alias(n) for n, c in out.items()])
