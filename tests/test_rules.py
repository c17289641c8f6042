import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditspark.functions import binning, cleaning, delinquency, features
from creditspark.models import sicr
from creditspark.models.preprocessing import encode_levels, fit_levels
from creditspark.plans.loan_master import loss_code


def column(spark, values, ddl, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.o for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_months(spark):
    got = column(spark, ["202101", "202113", "2021XX", "", None, "202012.0"], "string", cleaning.month_date("v"))
    assert got == [dt.date(2021, 1, 1), None, None, None, None, dt.date(2020, 12, 1)]
    assert column(spark, [201902, None], "int", cleaning.month_date("v")) == [dt.date(2019, 2, 1), None]


def test_postal_code_is_padded_but_never_cut(spark):
    assert column(spark, ["600", None, "123456"], "string", cleaning.pad_postal("v")) == ["00600", None, "123456"]


def test_numbers_and_sale_proceeds(spark):
    assert column(spark, ["1.5", "x", None], "string", cleaning.number("v")) == [1.5, None, None]
    assert column(spark, ["U", "10", None], "string", cleaning.sale_proceeds("v")) == [None, 10.0, None]


def test_delinquency_number_and_days(spark):
    values = ["0", "3", "RA", "XX", None]
    assert column(spark, values, "string", delinquency.dpd_numeric("v")) == [0, 3, 99, None, None]
    assert column(spark, values, "string", delinquency.dpd_days("v")) == [0, 90, None, None, None]


@pytest.mark.parametrize("dpd,code,event,quick", [
    (3.0, None, True, 1), (2.0, None, False, 0), (None, None, False, None), (None, "02", True, 1),
    (0.0, "2", True, 1), (0.0, "15", False, 0), (None, "01", False, None),
])
def test_default_rules_differ_on_nulls(spark, dpd, code, event, quick):
    df = spark.createDataFrame([(dpd, code)], "d double, z string").select(
        delinquency.default_event("d", "z").alias("e"),
        delinquency.default_flag_quick(F.col("d") * 30, "z").alias("q"))
    assert tuple(df.first()) == (event, quick)


def test_code_sets_differ(spark):
    df = spark.createDataFrame([("15",), ("09",), (None,)], "cd_zero_bal string")
    assert [r[0] for r in df.select(loss_code(["02", "03", "09", "15"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(loss_code(["02", "03", "15"])).collect()] == [True, False, False]


def test_stage_and_bucket(spark):
    df = spark.createDataFrame(
        [(0.0, False), (1.0, False), (2.0, True), (None, False), (4.0, True)], "d double, e boolean")
    got = df.select(delinquency.stage("d", "e").alias("s"), delinquency.dpd_bucket("d").alias("b")).collect()
    assert [tuple(r) for r in got] == [(1, "0"), (2, "30"), (3, "60"), (1, "unknown"), (3, "3+")]


def test_amortization_clip_keeps_null(spark):
    df = spark.createDataFrame(
        [(10.0, 0.0), (20.0, 10.0), (None, 10.0), (4.0, 10.0)], "current_actual_upb double, original_upb double")
    assert [r[0] for r in df.select(features.upb_amortization()).collect()] == [None, 0.0, None, 0.6]


def test_ra_recode_needs_ra_and_one_month(spark):
    df = spark.createDataFrame(
        [("RA", "5", 1), ("RA", "5", 2), ("RA", "3", 1), ("RA", "2", 1), ("RA", "4", 1), (None, "3", 1), ("1", "5", 1)],
        "s string, p string, g int")
    got = [r[0] for r in df.select(delinquency.recode_ra("s", "p", "g")).collect()]
    assert got == ["6", None, "4", "3", None, None, "1"]


def test_level_codes(spark):
    df = spark.createDataFrame([("P",), ("C",), (None,), ("N",)], "v string")
    levels = fit_levels(df, ["v"])
    assert levels == {"v": ["C", "N", "P"]}
    assert [r.v for r in encode_levels(df, ["v"], levels).collect()] == [2, 0, -1, 1]
    unseen = spark.createDataFrame([("Z",)], "v string")
    assert encode_levels(unseen, ["v"], levels).first().v == -1


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "credit_score_V1 int, year int, V3x int")
    assert cleaning.normalize_columns(df).columns == ["credit_score", "vintage_year", "V3x"]
    assert cleaning.first_present(df, "a", "year") == "year"
    assert cleaning.first_present(df, "a") is None
    assert cleaning.missing_features(df, ["year", "b"]) == ["b"]
    assert cleaning.rename_present(df, {"year": "y", "none": "n"}).columns[1] == "y"


def test_codes_and_tokens(spark):
    df = spark.createDataFrame([("9", "NA"), ("P", "x"), (None, "")], "occupancy_status string, w string")
    got = cleaning.clear_tokens(cleaning.clear_codes(df, {"occupancy_status": ["9"], "none": ["1"]}))
    assert [tuple(r) for r in got.collect()] == [(None, None), ("P", "x"), (None, None)]


def test_fallback_and_months_between(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0), (None, 7.0, 1.0), (3.0, None, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(cleaning.fallback(*[F.col(c) for c in "abc"])).collect()] == [100.0, 7.0, 3.0]
    df = spark.createDataFrame([(202001, 201912), (202003, None)], "a int, b int")
    assert [r[0] for r in df.select(cleaning.months_between("a", "b")).collect()] == [1, None]


def test_cut_sides(spark):
    right = binning.labelled_cut(F.col("v"), [0, 60, 70], ["a", "b"], right=True)
    left = binning.labelled_cut(F.col("v"), [0, 60, 70], ["a", "b"], right=False)
    values = [0.0, 60.0, 70.0, None]
    assert column(spark, values, "double", right) == [None, "a", "b", None]
    assert column(spark, values, "double", left) == ["a", "b", None, None]


def test_sicr_unknown_is_false(spark):
    rows = [(0.05, 0.01, 0.0), (0.012, 0.01, 0.0), (0.001, 0.0, 0.0), (None, 0.01, None), (0.0, 0.01, 1.0), (0.0151, 0.01, 0.0)]
    df = spark.createDataFrame(rows, "pd_current double, pd_origination double, dpd_numerico double")
    got = [r.sicr_pd_flag for r in sicr.assess(df.withColumn("ifrs9_stage", F.lit(1))).collect()]
    assert got == [1, 0, 0, 0, 1, 1]
    assert sicr.assess(df.withColumn("ifrs9_stage", F.lit(3))).first().ifrs9_stage_sicr == 3
