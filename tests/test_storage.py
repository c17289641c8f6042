"""Record of input files, deliveries, and tables stored in buckets."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.operators import summaries
from creditspark.plans import loans
from creditspark.sources import (
    append_delivery, file_ledger, open_buckets, read_deliveries, read_origination, write_buckets,
)
from creditspark.sources import delimited, ledger as L, quarters as Q
from creditspark.workload import tables

from conftest import SF


def written(path, lines, zipped=False):
    os.makedirs(path.parent, exist_ok=True)
    data = "".join(line + "\n" for line in lines).encode()
    path.write_bytes(gzip.compress(data) if zipped else data)


def test_ledger_names_every_file(spark, tmp_path):
    fields = ["a", "b", "c"]
    for i in range(9):
        written(tmp_path / f"good{i}.txt", [f"{i}|x|y"] * (i + 1))
    written(tmp_path / "zipped.txt.gz", ["1||"] * 5000, zipped=True)
    whole = gzip.compress(os.urandom(40_000).hex().encode() + b"\n1|2|3\n")
    (tmp_path / "cut.txt.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "not.txt.gz").write_bytes(b"this is no archive")
    written(tmp_path / "short.txt", ["1|2", "1|2|3"])
    written(tmp_path / "long.txt", ["1|2|3|4"] * 3)
    written(tmp_path / "none.txt", [])
    got = {os.path.basename(r.file): (r.status, r.rows, r.wrong_rows) for r in file_ledger(spark, f"{tmp_path}/*.txt*", fields).collect()}
    assert got == {
        **{f"good{i}.txt": (L.READ, i + 1, 0) for i in range(9)}, "zipped.txt.gz": (L.READ, 5000, 0),
        "cut.txt.gz": (L.UNREADABLE, None, None), "not.txt.gz": (L.UNREADABLE, None, None),
        "short.txt": (L.WRONG_FIELDS, 2, 1), "long.txt": (L.WRONG_FIELDS, 3, 3), "none.txt": (L.EMPTY, 0, 0)}
    lenient = {os.path.basename(r.file): r.status for r in file_ledger(spark, f"{tmp_path}/*.txt", fields, most_wrong=0.5).collect()}
    assert (lenient["short.txt"], lenient["long.txt"]) == (L.READ, L.WRONG_FIELDS)
    assert file_ledger(spark, f"{tmp_path}/good3.txt", fields).first().bytes == 4 * 6


def test_files_are_read_whole_or_not_at_all(spark, tmp_path):
    n = len(schema.ORIGINATION_FIELDS)
    at = schema.ORIGINATION_FIELDS.index(schema.LOAN)
    line = lambda loan: "|".join(loan if i == at else "" for i in range(n))
    written(tmp_path / "sample_2016/sample_orig_2016.txt", [line(f"A{i}") for i in range(40)])
    written(tmp_path / "sample_2017/sample_orig_2017.txt", [line("B1"), "1|2|3"])
    body = gzip.compress("".join(line(f"C{i}-{os.urandom(8).hex()}") + "\n" for i in range(20_000)).encode())
    (tmp_path / "sample_2018").mkdir()
    (tmp_path / "sample_2018/sample_orig_2018.txt.gz").write_bytes(body[:-2000])
    ledger = delimited.origination_ledger(spark, str(tmp_path))
    got = read_origination(spark, str(tmp_path), ledger=ledger)
    assert {(r[schema.LOAN][0], r.vintage_year) for r in got.collect()} == {("A", 2016)} and got.count() == 40
    with pytest.raises(ValueError):
        read_origination(spark, str(tmp_path), ledger=ledger.where("status <> 'read'"))


def test_a_failing_cluster_is_not_a_bad_file():
    assert not L._unreadable(RuntimeError("Job aborted due to stage failure: executor lost"))


ROWS = "orign_qtr string, loan string, v int"


def files(path):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def held(spark, path):
    return sorted((r.orign_qtr or "", r.loan, r.v) for r in read_deliveries(spark, path).collect())


def test_deliveries_are_neither_lost_nor_doubled(spark, tmp_path):
    path = str(tmp_path / "t")
    q1 = [("2020Q1", f"A{i}", i) for i in range(50)] + [("2020Q2", "A0", 7)]
    q2 = [("2020Q2", f"B{i}", i) for i in range(30)] + [(None, "B9", 1)]
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    assert append_delivery(df(q1), path, "d1")
    before = files(path)
    assert not append_delivery(df(q1[::-1]).repartition(5), path, "d1")  # the same rows in another order
    assert files(path) == before
    assert append_delivery(df(q2), path, "d2")
    assert all(files(path)[f] == t for f, t in before.items())  # nothing else is rewritten
    plain = lambda rows: sorted((a or "", b, c) for a, b, c in rows)
    assert held(spark, path) == plain(q1 + q2)
    late = [r for r in q1 if r[0] == "2020Q1"][:20] + [("2020Q3", "A1", 5)]  # a new version, without the second quarter
    assert append_delivery(df(late), path, "d1")
    assert held(spark, path) == plain(late + q2)
    assert append_delivery(df([("2020Q3", "A1", 5), ("2020Q3", "A1", 5)]), path, "d1")
    assert held(spark, path) == plain([("2020Q3", "A1", 5)] * 2 + q2)  # repeated rows of a delivery stay
    assert append_delivery(df([]), path, "d1") and held(spark, path) == plain(q2)


def test_rows_without_a_manifest_entry_do_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    append_delivery(spark.createDataFrame([("2020Q1", "A", 1)], ROWS), path, "d1")
    monkeypatch.setattr(Q, "MANIFEST", "broken")
    with pytest.raises(Exception):
        append_delivery(spark.createDataFrame([("2020Q1", "B", 2)], ROWS), path, "d2")
    monkeypatch.undo()
    spark.createDataFrame([("2020Q1", "B", 2, "2020Q1", "d2", 1)], ROWS + ", _orign_qtr string, delivery string, delivery_version int").write.mode(
        "append").partitionBy("_orign_qtr", "delivery", "delivery_version").parquet(f"{path}/rows")  # a run that was cut off
    assert held(spark, path) == [("2020Q1", "A", 1)]
    append_delivery(spark.createDataFrame([("2020Q1", "C", 3)], ROWS), path, "d2")
    assert held(spark, path) == [("2020Q1", "A", 1), ("2020Q1", "C", 3)]


def test_stored_buckets_need_no_exchange(spark, tmp_path):
    perf = write_buckets(tables.performance(spark, SF), "bucket_perf", str(tmp_path / "perf"), buckets=4)
    orig = write_buckets(tables.origination(spark, SF), "bucket_orig", str(tmp_path / "orig"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = loans.labelled_panel(perf, orig, rolling=True, trimmed=True)
        per_loan = summaries.loan_summary(panel)
        shown = panel.select(schema.LOAN, schema.MONTH, "default_12m", "max_dpd_12m")
        for df in (panel, per_loan, panel.groupBy(schema.LOAN).agg(F.max("max_dpd_12m")), shown):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = loans.labelled_panel(tables.performance(spark, SF), tables.origination(spark, SF), rolling=True).select(shown.columns)
        assert shown.exceptAll(plain).isEmpty() and plain.exceptAll(shown).isEmpty()
        spark.sql("DROP TABLE bucket_perf")  # the files stay; another session opens them again
        again = open_buckets(spark, "bucket_again", str(tmp_path / "perf"), buckets=4)
        plan = again.groupBy(schema.LOAN).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and again.count() == plain.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_perf", "bucket_orig", "bucket_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
