"""Registered queries against SQL, plans, and the whole run."""

import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check_oracle
from creditspark.models import training
from creditspark.plans import loans, pipeline
from creditspark.workload import tables

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


CHECKED = [
    "scan_pipe", "default_rate_by_vintage_stage", "feature_dataset", "loan_master", "macro_monthly",
    "validation_report", "lifetime_backtest", "scenario_pd", "stratified_sample", "describe_origination",
    "calibrate_isotonic", "dpd_mix_monthly", "feature_correlation",
]


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check_oracle.ordered(df.columns, df.collect()) == check_oracle.ordered(columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["public_tokenizers", "creditspark.llm", "corpus_pipeline"])
def test_queries_without_what_only_the_text_operators_need(missing):
    code = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 150 and set(e.oracle_sql()) <= names and "loan_master" in names and "pipeline" not in names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(contract.__file__)), timeout=120)


# --- plans ------------------------------------------------------------------


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    perf, orig = str(tmp_path / "perf"), str(tmp_path / "orig")
    tables.performance(spark, SF).write.parquet(perf)
    tables.origination(spark, SF).write.parquet(orig)
    return spark.read.parquet(perf), spark.read.parquet(orig)


def test_one_exchange_per_input(spark, tmp_path):
    perf, orig = stored(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = loans.labelled_panel(perf, orig, rolling=True)
        per_loan = panel.groupBy("loan_sequence_number").agg(F.max("default_12m").alias("d"), F.max("max_dpd_12m").alias("m"))
        plan = executed(per_loan)
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
        read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        assert any("current_loan_delinquency_status" in r and "net_sale_proceeds" not in r for r in read)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_loan_master_plan(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = contract.queries()["loan_master"](spark, SF)
        # Grouping of the view, one on the loan for history, one for origination.
        assert len(re.findall(r"Exchange hashpartitioning", executed(df))) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scan(spark, tmp_path):
    perf, _ = stored(spark, tmp_path)
    from creditspark.operators.joins import loan_lookup

    plan = executed(loan_lookup(perf, "F00000000007").select("loan_sequence_number", "loan_age"))
    assert "EqualTo(loan_sequence_number,F00000000007)" in plan
    assert "ReadSchema: struct<loan_sequence_number:string,loan_age:double>" in plan


def test_macro_is_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in executed(contract.queries()["macro_join"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- the whole run ----------------------------------------------------------


def test_whole_run(spark, tmp_path):
    from creditspark import schema

    root, out = str(tmp_path / "raw"), str(tmp_path / "out")
    perf, orig = tables.raw_performance(spark, SF), tables.raw_origination(spark, SF)
    for df, fields, kind in ((orig, schema.ORIGINATION_FIELDS, "orig"), (perf, schema.PERFORMANCE_FIELDS, "svcg")):
        text = df.select(*[
            (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in fields], "vintage_year")
        rows = text.select(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in fields]).alias("l"), "vintage_year").toPandas()
        for year, part in rows.groupby("vintage_year"):
            folder = tmp_path / "raw" / f"sample_{year}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"sample_{kind}_{year}.txt").write_text("\n".join(part.l) + "\n")
    options = {"gbt": {"maxIter": 3}}
    arguments = dict(macro_series=tables.macro_series(spark, SF), kinds=("logistic", "gbt"), options=options,
                     least_curve=20, least_scenario=10, least_backtest=5, sample_rows=200)
    results = pipeline.run(spark, root, out, **arguments)
    table = {r.model: r for r in results["resultados_modelos"].collect()}
    assert set(table) == {"logistic", "gbt"} and all(0 <= r.auc_val <= 1 for r in table.values())
    assert results["validacion_metricas"].count() == 2
    assert results["ecl_by_scenario"].count() == 3
    assert results["transition_matrix_observed"].count() == 3
    # The stored panel equals the one computed from the tables.
    panel = spark.read.parquet(f"{out}/data/panel_con_default")
    keys = ["loan_sequence_number", "monthly_reporting_period", "default_12m", "ifrs9_stage"]
    assert panel.select(*keys).exceptAll(tables.labelled(spark, SF).select(*keys)).isEmpty()
    assert training.load_model(f"{out}/models/gbt") is not None
    # A second run with reuse fits and writes nothing again and gives the same tables.
    rates, loans = results["transition_key_rates"].collect(), results["explicacion_prestamos"].count()
    assert len(rates) == 1 and loans > 0

    def no_fit(*args, **kwargs):
        raise AssertionError("a stored model was fitted again")

    kept = training.fit_calibrated
    training.fit_calibrated = no_fit
    try:
        again = pipeline.run(spark, root, out, reuse=True, **arguments)
    finally:
        training.fit_calibrated = kept
    for name, df in again.items():
        assert df.columns == results[name].columns and df.count() == results[name].count()


# --- one read per table -----------------------------------------------------


def scans(plan):
    return plan.count("FileScan") + plan.count("Scan parquet")


def test_unions_of_one_table_read_it_once(spark):
    for name in ("union_vintages", "stack_tables"):
        assert executed(contract.queries()[name](spark, SF)).count("Location") == 1


def test_no_scratch_folder_off_local_mode(monkeypatch):
    from types import SimpleNamespace

    from creditspark import scale

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        scale.scratch_dir(cluster)
