import random

import pytest
from pyspark.sql import functions as F

from creditspark.operators import history
from creditspark.operators.history import lag_features
from creditspark.plans import loan_master as lm
from creditspark.scale import entity_windows, row_hash


def rows_of(loan, months, events):
    return [(loan, m, float(3 * e), bool(e)) for m, e in zip(months, events)]


SCHEMA = "loan_sequence_number string, monthly_reporting_period int, dpd_numerico double, evento_default boolean"


def target(df):
    out = history.lookahead_default(df).collect()
    return {(r.loan_sequence_number, r.monthly_reporting_period): r.default_12m for r in out}


def test_next_twelve_rows(spark):
    df = spark.createDataFrame(rows_of("A", range(1, 15), [0] * 13 + [1]), SCHEMA)
    got = target(df)
    assert [got["A", m] for m in range(1, 15)] == [0] + [1] * 12 + [0]


def test_rows_not_months_and_last_row(spark):
    df = spark.createDataFrame(rows_of("A", [1, 2, 30], [0, 0, 1]) + rows_of("B", [5], [1]), SCHEMA)
    assert target(df) == {("A", 1): 1, ("A", 2): 1, ("A", 30): 0, ("B", 5): 0}


def test_all_null_window_stays_null(spark):
    df = spark.createDataFrame([("A", m, None) for m in range(3)],
                               "loan_sequence_number string, monthly_reporting_period int, dpd_numerico double")
    assert {r.max_dpd_3m for r in history.rolling_max_dpd(df).collect()} == {None}


def brute(rows):
    """Look-ahead target and maxima by position within the loan."""
    out, loans = [], {}
    for r in rows:
        loans.setdefault(r[0], []).append(r)
    for loan, months in loans.items():
        months.sort(key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3]))
        for i, r in enumerate(months):
            ahead = any(x[3] for x in months[i + 1:i + 13])
            known = lambda n: [x[2] for x in months[max(0, i - n + 1):i + 1] if x[2] is not None]  # noqa: E731,B023
            out.append((loan, r[1], int(ahead), *[max(known(n), default=None) for n in (3, 6, 12)]))
    return sorted(out, key=str)


def generated(seed):
    rng = random.Random(seed)
    rows = []
    for loan, n in [("hot", 400), (None, 90), ("mid", 25), ("one", 1), ("few", 7)]:
        for i in range(n):
            # Repeated months on purpose; the event follows the delinquency.
            d = rng.choice([0.0, 0.0, 1.0, 2.0, 3.0, None])
            rows.append((loan, rng.randrange(max(n // 2, 1)), d, d == 3.0))
    return rows


def compute(df):
    def columns(w):
        return {"t": history.next_event("evento_default", w)} | {
            f"m{n}": history.last_max("dpd_numerico", w, n) for n in (3, 6, 12)}

    from creditspark.scale import entity_windows
    out = entity_windows(df, "loan_sequence_number", "monthly_reporting_period", columns,
                         behind=11, ahead=12, ties=history.TIES)
    got = out.select("loan_sequence_number", "monthly_reporting_period", "t", "m3", "m6", "m12").collect()
    return sorted((tuple(r) for r in got), key=str), out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_hot_key_chunks_equal_brute_force(spark, large, seed, parts):
    rows = generated(seed)
    random.Random(seed).shuffle(rows)
    got, out = compute(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got == brute(rows)
    assert "_chunk" in out._jdf.queryExecution().toString()


def test_short_plan_equals_brute_force(spark, small):
    rows = generated(3)
    got, out = compute(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert "_chunk" not in out._jdf.queryExecution().toString()


def test_no_hot_key_keeps_one_window(spark, large):
    df = spark.createDataFrame(rows_of("A", range(5), [0, 0, 1, 0, 0]), SCHEMA)
    assert "_chunk" not in history.lookahead_default(df)._jdf.queryExecution().toString()


# --- loan master ------------------------------------------------------------

PERF = ("id_loan string, period int, curr_act_upb double, delq_sts string, flag_mod string, cd_zero_bal string, "
        "cur_int_rt double")


def months(loan, statuses, upb=None, codes=None, mods=None, start=202001, rates=None):
    n = len(statuses)
    pick = lambda x, i, d: (x or {}).get(i, d)
    return [(loan, start + i, pick(upb, i, 100.0), s, pick(mods, i, None), pick(codes, i, None), pick(rates, i, 4.0))
            for i, s in zip(range(n), statuses)]


def master(spark, rows, orig=250.0):
    loans = spark.createDataFrame([(x, orig) for x in sorted({r[0] for r in rows})], "id_loan string, orig_upb double")
    return {r.id_loan: r for r in lm.loan_master(spark.createDataFrame(rows, PERF), loans).collect()}


def test_lags_and_first_row_defaults(spark):
    df = spark.createDataFrame(months("A", ["1", "2", "3"], upb={0: 90.0, 1: 80.0}), PERF)
    got = [tuple(r) for r in history.lag_features(df).orderBy("period").select(
        "prior_upb", "prior_int_rt", "prior_delq_sts", "prior_delq_sts_2", "prior_period", "period_diff").collect()]
    assert got == [(0.0, 4.0, "00", "00", None, None), (90.0, 4.0, "1", None, 202001, 1), (80.0, 4.0, "2", "1", 202002, 1)]


def test_exact_bucket_and_fallback_balance(spark):
    m = master(spark, months("A", ["1", "3", "0"], upb={0: 0.0, 1: 0.0}))["A"]
    assert (m.dlq_ever30_ind, m.dlq_ever30_upb) == (1, 250.0)
    assert (m.dlq_ever60_ind, m.dlq_ever60_upb) == (None, None)
    assert (m.dlq_everd90_ind, m.dlq_everd90_upb) == (1, 250.0)


def test_pre_d180(spark):
    rows = months("A", ["0", "4", "5", "6"], codes={1: "03"}, upb={1: 77.0})
    rows += months("B", ["4", "5", "6"], upb={2: 55.0}) + months("C", ["6", "6"], codes={1: "02"}, upb={0: 44.0})
    got = master(spark, rows)
    assert (got["A"].pd_d180_ind, got["A"].pd_d180_upb) == (1, 77.0)
    assert (got["B"].pd_d180_ind, got["B"].pd_d180_upb) == (1, 55.0)
    assert got["C"].pd_d180_upb == 44.0


def test_ra_without_known_bucket_counts_as_early(spark):
    got = master(spark, months("A", ["0", "RA"], upb={1: 60.0}) + months("B", ["5", "RA"], upb={1: 61.0}))
    assert got["A"].pd_d180_upb == 60.0
    assert (got["B"].pd_d180_upb, got["B"].dlq_everd180_ind) == (61.0, 1)


def test_terminal_outcomes_and_modification(spark):
    rows = months("A", ["0", "0"], codes={1: "01"}, upb={0: 90.0, 1: 0.0}) + months("B", ["0", "0"], mods={1: "Y"}, upb={1: 0.0})
    rows += months("C", ["0", "5", "RA"], codes={2: "09"}, upb={2: 0.0}, rates={2: 0.0})
    got = master(spark, rows)
    assert (got["A"].prepay_count, got["A"].prepay_upb, got["A"].rmng_upb) == (1, 90.0, None)
    assert (got["B"].mod_ind, got["B"].mod_upb, got["B"].rmng_upb) == (1, 100.0, 0.0)
    assert (got["C"].default_count, got["C"].current_int_rt, got["C"].zero_bal_delq_sts) == (1, 4.0, "RA")


def test_default_record_months(spark):
    loans = spark.createDataFrame([("A", 250.0), ("B", 250.0)], "id_loan string, orig_upb double")
    rows = months("A", ["3", "RA", "RA"], codes={2: "09"}) + months("B", ["3", "7"], codes={1: "02"})
    history_ = history.lag_features(lm.history_detail(spark.createDataFrame(rows, PERF), loans))
    got = {r.id_loan: r for r in lm.default_record(lm.terminal_record(history_)).collect()}
    assert (got["A"].dflt_delq_sts, got["A"].acqn_to_dispn, got["A"].mths_dlq_dflt_dispn, got["A"].mths_dlq_dflt_acqn) == ("3", 1, 4.0, 3.0)
    assert (got["B"].dflt_delq_sts, got["B"].acqn_to_dispn, got["B"].mths_dlq_dflt_dispn) == ("7", None, 7.0)


def test_repeated_rows_are_dropped_once(spark, large):
    rows = months("A", ["1", "2", "3"] * 9, start=202001)
    rows = [(r[0], 202001 + i, *r[2:]) for i, r in enumerate(rows)]
    once = history.lag_features(spark.createDataFrame(rows, PERF), distinct=True)
    twice = history.lag_features(spark.createDataFrame(rows + rows, PERF), distinct=True)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(once) == key(twice) and once.count() == 27
    assert twice.filter(F.col("prior_period").isNull()).count() == 1


def test_order_of_repeated_months_does_not_depend_on_the_layout(spark):
    rows = [("L1", 202001 + i // 3, float(10 * (i * 7 % 11)), 3.0, "0", None) for i in range(12)]
    names = "id_loan string, period int, curr_act_upb double, cur_int_rt double, delq_sts string, flag_mod string"
    seen = set()
    for seed in range(4):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        out = lag_features(spark.createDataFrame(shuffled, names).repartition(seed + 1))
        seen.add(tuple(sorted((r.period, r.curr_act_upb, r.prior_upb) for r in out.collect())))
    assert len(seen) == 1


def test_one_hot_loan_in_one_month_is_spread(spark, large):
    """Repeats of one month of one loan, after a join, fall into many cells and chunks."""
    n = 400
    left = spark.range(n).selectExpr("'L1' AS k", "1 AS m", "id AS v")
    df = left.join(spark.createDataFrame([("L1", 5)], "k string, w int"), "k")
    out = entity_windows(df, "k", "m", lambda w: {"back": F.lag("v", 1).over(w), "next": F.lead("v", 1).over(w)}, behind=1, ahead=1)
    rows = out.collect()
    assert len(rows) == n and sum(r.back is None for r in rows) == 1 and sum(r.next is None for r in rows) == 1
    follows = {r.v: r.next for r in rows}
    assert all(follows[r.back] == r.v for r in rows if r.back is not None)
    cells = df.select(F.shiftright(row_hash(df), 52).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 13  # the chunk size of this test


# --- repeats and calendar months ----------------------------------------------


def test_only_loans_with_repeats_read_the_whole_row(spark):
    names = SCHEMA + ", note string"
    clean = [(*r, "x") for r in rows_of("A", range(6), [0, 0, 1, 0, 0, 0]) + rows_of("B", range(4), [0] * 4)]
    plan = history.lookahead_default(spark.createDataFrame(clean, names)).select("loan_sequence_number", "default_12m")._jdf.queryExecution().toString()
    assert "xxhash64" not in plan
    repeats = clean + [("B", 2, 0.0, False, "y")]
    got = history.lookahead_default(spark.createDataFrame(repeats, names))
    assert "xxhash64" in got._jdf.queryExecution().toString()
    assert sorted((r[0], r[1], r.default_12m) for r in got.collect()) == [
        ("A", 0, 1), ("A", 1, 1), ("A", 2, 0), ("A", 3, 0), ("A", 4, 0), ("A", 5, 0), ("B", 0, 0), ("B", 1, 0), ("B", 2, 0), ("B", 2, 0), ("B", 3, 0)]


def test_repeated_loans_of_the_other_table_repeat_rows(spark):
    from creditspark.scale import repeated_keys
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "k string, m int")
    assert repeated_keys(rows, "k", "m") is None
    parents = spark.createDataFrame([("A",), ("B",), ("B",)], "k string")
    assert [r.k for r in repeated_keys(rows, "k", "m", parents=parents).collect()] == ["B"]


def by_calendar(rows, horizon=12):
    out = []
    for loan, m, dpd, _ in rows:
        own = [r for r in rows if r[0] == loan and r[1] is not None]
        if m is None:
            out.append((loan, m, 0, dpd, dpd, dpd))
            continue
        ahead = any(r[3] for r in own if m < r[1] <= m + horizon)
        back = lambda n: max((r[2] for r in own if m - n < r[1] <= m and r[2] is not None), default=None)  # noqa: E731,B023
        out.append((loan, m, int(ahead), back(3), back(6), back(12)))
    return sorted(out, key=str)


@pytest.mark.parametrize("plan", ["large", "small"])
def test_calendar_windows_equal_brute_force(spark, request, plan):
    request.getfixturevalue(plan)
    rows = [(loan, None if m is None else m * 3 // 2, d, e) for loan, m, d, e in generated(5)] + [("few", None, 2.0, False), ("hot", None, 3.0, True)]
    df = history.lookahead_default(spark.createDataFrame(rows, SCHEMA).repartition(3), calendar=True)
    out = history.rolling_max_dpd(df, calendar=True)
    got = sorted((tuple(r) for r in out.select(
        "loan_sequence_number", "monthly_reporting_period", "default_12m", "max_dpd_3m", "max_dpd_6m", "max_dpd_12m").collect()), key=str)
    assert got == by_calendar(rows)


@pytest.mark.parametrize("plan", ["large", "small"])
def test_gaps_do_not_stretch_the_horizon_and_dates_count_months(spark, request, plan):
    request.getfixturevalue(plan)
    import datetime
    dates = [datetime.date(2020 + m // 12, m % 12 + 1, 1) for m in (0, 1, 13, 26)]
    rows = [("A", d, 0.0, i == 2) for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, SCHEMA.replace("period int", "period date"))
    got = {r.monthly_reporting_period: r.default_12m for r in history.lookahead_default(df, calendar=True).collect()}
    assert [got[d] for d in dates] == [0, 1, 0, 0]
    seen = {r.monthly_reporting_period for r in history.lookahead_default(df, calendar=True, drop_censored=True).collect()}
    assert seen == set(dates[:3])


@pytest.mark.parametrize("plan", ["large", "small"])
def test_censored_rows_are_dropped_on_wish(spark, request, plan):
    request.getfixturevalue(plan)
    df = spark.createDataFrame(rows_of("A", range(60), [0] * 59 + [1]) + rows_of("B", range(5), [0] * 5), SCHEMA)
    got = history.lookahead_default(df, drop_censored=True).collect()
    assert sorted(r.monthly_reporting_period for r in got) == list(range(48)) and {r.loan_sequence_number for r in got} == {"A"}
    assert sum(r.default_12m for r in got) == 1


def test_stage_some_months_later(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("A", 4, 2), ("A", 4, 3), ("A", 7, 1)], "loan_sequence_number string, monthly_reporting_period int, ifrs9_stage int")
    got = {(r[1], r.later) for r in history.stage_after(df, 3, "later", calendar=True).collect()}
    assert got == {(1, 3), (4, 1)}
