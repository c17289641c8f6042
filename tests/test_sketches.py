import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from creditspark.models import preprocessing
from creditspark.operators import sketches
from creditspark.sources import append_delivery, read_deliveries


def panel(spark, n=60_000):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(pd.DataFrame({
        "vintage_year": rng.choice([2016, 2017, 2018], n, p=[0.7, 0.2, 0.1]), "loan": rng.integers(0, 20_000, n).astype(str),
        "upb": rng.lognormal(11, 1, n)})).persist()


def test_merged_sketches_keep_the_bounds_and_a_new_vintage_adds_its_own(spark, tmp_path):
    df, path = panel(spark), str(tmp_path / "s")
    for year in (2016, 2017, 2018):
        one = sketches.sketch_table(df.filter(F.col("vintage_year") == year), ["vintage_year"], ["loan"], ["upb"])
        assert append_delivery(one, path, str(year), by="vintage_year")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "rows").rglob("*.parquet")}
    late = df.limit(500).withColumn("vintage_year", F.lit(2019)).withColumn("loan", F.concat(F.lit("x"), "loan"))
    assert append_delivery(sketches.sketch_table(late, ["vintage_year"], ["loan"], ["upb"]), path, "2019", by="vintage_year")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())

    stored = read_deliveries(spark, path, by="vintage_year").drop("delivery")
    merged = sketches.estimates(sketches.merge_sketches(stored), [0.1, 0.5, 0.9]).first()
    whole = df.unionByName(late).toPandas()
    assert merged.n_rows == len(whole)
    assert abs(merged.n_loan / whole.loan.nunique() - 1) < 5 * sketches.DISTINCT_ERROR
    for p, q in zip([0.1, 0.5, 0.9], merged.q_upb):
        assert abs((whole.upb <= q).mean() - p) < 2 * sketches.RANK_ERROR
    once = sketches.estimates(sketches.sketch_table(df.unionByName(late), [], ["loan"], ["upb"])).first()
    assert abs(once.n_loan - merged.n_loan) <= 0.05 * once.n_loan


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 1.0), (2, "a", None), (None, "b", 3.0)], "g int, k string, v double")
    got = {r.g: (r.n_rows, r.n_k, r.q_v) for r in sketches.estimates(sketches.sketch_table(df, ["g"], ["k"], ["v"]), [0.5]).collect()}
    assert got == {1: (1, 0, None), 2: (2, 1, [1.0]), None: (1, 1, [3.0])}
    assert sketches.estimates(sketches.merge_sketches(sketches.sketch_table(df.filter("false"), ["g"], ["k"], ["v"]), ["g"])).collect() == []


def test_a_heavy_level_is_not_shuffled(spark, monkeypatch):
    """20,000 levels, one of them on half the rows: no task of the join gets more than its share."""
    monkeypatch.setattr(preprocessing, "BROADCAST_ROWS", 1000)
    n, levels = 80_000, 20_000
    df = spark.range(n).selectExpr(
        "id", f"CASE WHEN id % 2 = 0 THEN 'h' WHEN id % 7 = 0 THEN null ELSE cast(id % {levels} AS string) END AS a")
    fitted = preprocessing.fit_levels(df, ["a"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = preprocessing.encode_levels(df, ["a"], fitted)
        want = {v: i for i, v in enumerate(sorted({r.a for r in df.select("a").distinct().collect()} - {None}))}
        got = dict(map(tuple, out.withColumnRenamed("a", "c").join(df, "id").select("a", "c").distinct().collect()))
        assert got == want | {None: -1} and out.count() == n
        parts = out.filter(F.col("a") != want["h"]).filter("a >= 0").groupBy(F.spark_partition_id().alias("p")).count()
        assert max(r["count"] for r in parts.collect()) < n / 2
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_counted_dictionary_is_broadcast(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 500 AS string) AS a")
    out = preprocessing.encode_levels(df, ["a"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert out.agg(F.max("a"), F.countDistinct("a")).first()[:] == (499, 500)
