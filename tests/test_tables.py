"""Macro series, joins, summaries, curves and text ingest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.models import scenarios
from creditspark.operators import curves, joins, macro, summaries, transitions
from creditspark.sources import (
    read_csv_table, read_origination, read_performance, read_pipe, read_quarterly, read_table, write_csv, write_table,
)


def series(spark, name, points):
    rows = [(name, dt.date(y, m, d), v) for y, m, d, v in points]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def values(df, column="value"):
    return [(r.date.isoformat()[:7], r[column]) for r in df.orderBy("date").collect()]


def test_quarterly_holds_until_next_and_ends_there(spark):
    got = macro.quarterly_to_monthly(series(spark, "USSTHPI", [(2020, 1, 1, 5.0), (2020, 4, 1, 6.0)]))
    assert values(got) == [("2020-01", 5.0), ("2020-02", 5.0), ("2020-03", 5.0), ("2020-04", 6.0)]


def test_weekly_mean_and_monthly_last_keep_gap_months(spark):
    points = [(2020, 1, 6, 1.0), (2020, 1, 13, 3.0), (2020, 3, 2, 4.0)]
    assert values(macro.weekly_to_monthly(series(spark, "MORTGAGE30US", points))) == [
        ("2020-01", 2.0), ("2020-02", None), ("2020-03", 4.0)]
    points = [(2020, 1, 1, 1.0), (2020, 1, 15, None), (2020, 2, 1, 2.0)]
    assert values(macro.monthly_last(series(spark, "UNRATE", points))) == [("2020-01", 1.0), ("2020-02", 2.0)]


def test_year_on_year_fills_only_percent(spark):
    rows = [(dt.date(2020 + i // 12, i % 12 + 1, 1), 100.0 + i if i != 12 else None, float(i) if i != 12 else None)
            for i in range(14)]
    df = spark.createDataFrame(rows, "date date, hpi double, u double")
    got = macro.year_on_year(df, {"hpi": "h"}, {"u": "d"}).orderBy("date").collect()
    assert got[11].h is None and got[12].h == pytest.approx((111 / 100 - 1) * 100)
    assert got[12].d is None and got[13].d == 12.0


def test_outer_align_keeps_every_month(spark):
    s = series(spark, "UNRATE", [(2020, 1, 1, 1.0)]).unionByName(series(spark, "FEDFUNDS", [(2020, 3, 1, 2.0)]))
    got = macro.macro_monthly(s).orderBy("date").collect()
    assert [(r.unemployment_rate, r.fed_funds_rate, r.hpi) for r in got] == [(1.0, None, None), (None, 2.0, None)]


def test_panel_takes_origination_vintage(spark):
    perf = spark.createDataFrame([("A ", 1, 2016), ("X", 1, 2016)], "loan_sequence_number string, m int, vintage_year int")
    orig = spark.createDataFrame([(" A", 2, 2017)], "loan_sequence_number string, m int, vintage_year int")
    got = {r.loan_sequence_number: (r.m, r.m_orig, r.vintage_year) for r in joins.build_panel(perf, orig).collect()}
    assert got == {"A": (1, 2, 2017), "X": (1, None, None)}
    check = joins.orphan_check(perf, orig.withColumn("credit_score", F.lit(None).cast("double"))).first()
    assert tuple(check) == (2, 1, 2)
    assert [r.loan_sequence_number for r in joins.orphan_rows(perf, orig).collect()] == ["X"]
    assert joins.with_macro(perf, None) is perf


def test_first_occurrence_keeps_different_ties(spark):
    df = spark.createDataFrame([("A", 2, 1), ("A", 2, 2), ("A", 2, 2), ("A", 3, 1)], "id_loan string, period int, v int")
    assert joins.first_occurrence(df, F.lit(True)).count() == 2


def test_null_report_and_correlation(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.5, 5.0), (None, 1.0, 2.0), (7.0, 0.0, 2.5)]
    df = spark.createDataFrame(rows * 20, "a double, b double, c double").repartition(3)
    nulls = {r.column_name: (r.n_null, r.pct_null) for r in summaries.null_report(df).collect()}
    assert nulls == {"a": (20, 20.0), "b": (0, 0.0), "c": (20, 20.0)}
    got = {(r.feature_a, r.feature_b): r["corr"] for r in summaries.feature_correlation(df, ["a", "b", "c"]).collect()}
    want = df.toPandas().corr()
    assert len(got) == 3 and all(v == pytest.approx(want.loc[k]) for k, v in got.items())


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert summaries.feature_correlation(df, ["a", "b"]).first()["corr"] is None


def test_matrix_rows_sum_to_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "ifrs9_stage int, later int")
    long = transitions.stage_matrix(df, "later")
    wide = transitions.pivot_matrix(long, "ifrs9_stage", "later", "prob").collect()
    assert all(abs(r.to_1 + r.to_2 + r.to_3 - 1) < 1e-12 for r in wide)
    moved = df.withColumns({"vintage_year": F.lit(2016), "y": F.lit(2020)})
    counted = transitions.transition_counts(moved, "later", F.col("y"))
    both = [sorted(map(tuple, transitions.stage_matrix(t, "later").collect())) for t in (moved, counted)]
    assert both[0] == both[1]
    cure = transitions.cure_rate_yearly(counted, "later", F.col("year")).first()
    assert cure.n == 3 and cure.cure_rate == pytest.approx(1 / 3)
    assert transitions.key_rates(long, "later").first().stage_1_to_3 is None


def test_curve_identity_and_asof(spark):
    df = spark.createDataFrame([(float(a), 0.01 * a) for a in (1, 2, 5)], "loan_age double, pd_marginal double")
    got = curves.cumulative_pd(df).orderBy("loan_age").collect()
    assert got[-1].pd_lifetime_acum == pytest.approx(1 - 0.99 * 0.98 * 0.95)
    asof = {r.horizon_months: r.pred_lifetime_pd for r in curves.curve_asof(curves.cumulative_pd(df), [0, 4, 9]).collect()}
    assert asof[0] is None and asof[4] == pytest.approx(1 - 0.99 * 0.98) and asof[9] == got[-1].pd_lifetime_acum


def test_backtest_counts_only_loans_seen_to_the_horizon(spark):
    rows = [("A", 2016, 12.0, True), ("A", 2016, 24.0, False), ("B", 2016, 24.0, False), ("C", 2016, 5.0, True)]
    df = spark.createDataFrame(rows, "loan_sequence_number string, vintage_year int, loan_age double, evento_default boolean")
    got = {r.horizon_months: (r.obs_default_rate, r.n_loans) for r in curves.observed_lifetime(df, [12, 24, 36], 1).collect()}
    assert got == {12: (0.5, 2), 24: (0.5, 2)}


def test_shock_keeps_null_and_floor(spark):
    df = spark.createDataFrame([(100.0, 0.5, 1.0), (None, None, None)], "hpi double, unemployment_rate double, fed_funds_rate double")
    got = {(r.scenario, r.hpi, r.unemployment_rate, r.fed_funds_rate) for r in scenarios.scenario_shock(df).collect()}
    assert ("pessimistic", 75.0, 4.5, 0.0) in got and ("optimistic", 102.0, 0.0, 1.0) in got
    assert ("optimistic", None, None, None) in got and len(got) == 6
    assert "hpi" not in scenarios.scenario_shock(df.select("fed_funds_rate")).columns


# --- text files -------------------------------------------------------------


def line(fields, given):
    return "|".join(given.get(f, "") for f in fields)


@pytest.fixture
def raw_root(tmp_path):
    for year in (2016, 2017):
        folder = tmp_path / f"sample_{year}"
        folder.mkdir()
        loan = f"F{year - 2000}Q10000001"
        orig = {"credit_score": "9999", "original_ltv": "80", "loan_sequence_number": loan, "channel": "9",
                "postal_code3_trunc": "60000", "seller_name": 'Bank "One"', "first_payment_date": f"{year}03"}
        (folder / f"sample_orig_{year}.txt").write_text(line(schema.ORIGINATION_FIELDS, orig) + "\n")
        perf = [{"loan_sequence_number": loan, "monthly_reporting_period": f"{year}0{m}", "net_sale_proceeds": "U",
                 "current_loan_delinquency_status": "NA", "current_actual_upb": "1000.5",
                 "estimated_loan_to_value_eltv": "999"} for m in (3, 4)]
        (folder / f"sample_svcg_{year}.txt").write_text("\n".join(line(schema.PERFORMANCE_FIELDS, p) for p in perf) + "\n")
    return str(tmp_path)


def test_reads_all_vintage_folders(spark, raw_root):
    orig = {r.vintage_year: r for r in read_origination(spark, raw_root).collect()}
    assert set(orig) == {2016, 2017}
    r = orig[2016]
    assert (r.credit_score, r.original_ltv, r.channel, r.seller_name) == (None, 80.0, None, 'Bank "One"')
    perf = read_performance(spark, raw_root)
    assert perf.count() == 4
    p = perf.first()
    assert (p.net_sale_proceeds, p.estimated_loan_to_value_eltv, p.current_actual_upb) == (None, None, 1000.5)
    assert p.current_loan_delinquency_status == "NA"


def test_null_tokens_are_an_option(spark, raw_root):
    path = os.path.join(raw_root, "sample_2016", "sample_svcg_2016.txt")
    df = read_pipe(spark, path, schema.PERFORMANCE_FIELDS, null_tokens=schema.NULL_TOKENS)
    assert df.filter(F.col("current_loan_delinquency_status").isNotNull()).count() == 0


def test_quarterly_files(spark, tmp_path):
    for q in ("2019Q1", "2019Q2"):
        folder = tmp_path / f"historical_data_{q}"
        folder.mkdir()
        (folder / f"historical_data_{q}.txt").write_text(
            line(schema.ORIGINATION_FIELDS, {"loan_sequence_number": f"F{q}", "original_upb": "5"}) + "\n")
        (folder / f"historical_data_time_{q}.txt").write_text(
            line(schema.PERFORMANCE_FIELDS, {"loan_sequence_number": f"F{q}", "monthly_reporting_period": "201901"}) + "\n")
    orig, perf = read_quarterly(spark, str(tmp_path))
    assert sorted((r.loan_sequence_number, r.orign_qtr, r.original_upb) for r in orig.collect()) == [
        ("F2019Q1", "2019Q1", 5.0), ("F2019Q2", "2019Q2", 5.0)]
    assert sorted(r.orign_qtr for r in perf.collect()) == ["2019Q1", "2019Q2"]


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("A", 2016, 1.5)], "loan string, vintage_year int, v double")
    path = str(tmp_path / "t")
    write_table(df, path, sort_by=["loan"])
    assert tuple(read_table(spark, path, ["loan", "v", "none"]).first()) == ("A", 1.5)
    with pytest.raises(Exception, match="(?i)exists"):
        write_table(df, path)
    write_table(df, str(tmp_path / "f"), compact_numbers=True)
    assert dict(read_table(spark, str(tmp_path / "f")).dtypes)["v"] == "float"
    write_csv(df, str(tmp_path / "c"))
    assert tuple(read_csv_table(spark, str(tmp_path / "c"), "loan string, vintage_year int, v double").first()) == ("A", 2016, 1.5)


def test_many_levels_are_encoded_by_a_join(spark, monkeypatch):
    from creditspark.models import preprocessing

    n = 20_000
    df = spark.range(n).selectExpr("lpad(cast(id AS string), 6, '0') AS a", "cast(id % 3 AS string) AS b").unionByName(
        spark.createDataFrame([(None, None)], "a string, b string"))
    out = preprocessing.encode_levels(df, ["a", "b"])
    assert out.columns == ["a", "b"]
    assert out.agg(F.min("a"), F.max("a"), F.countDistinct("a")).first()[:] == (-1, n - 1, n + 1)
    assert sorted(r.b for r in out.select("b").distinct().collect()) == [-1, 0, 1, 2]
    few = preprocessing.encode_levels(df.where("a < '000050'"), ["a"], preprocessing.fit_levels(df, ["a"]))
    assert sorted(r.a for r in few.collect()) == list(range(50))


def test_many_tasks_write_few_files(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "cast(2016 + id % 4 AS int) AS vintage_year").repartition(40)
    write_table(df, str(tmp_path / "t"))
    files = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert len(files) <= 8 and spark.read.parquet(str(tmp_path / "t")).count() == 2000
