from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.models import explain, preprocessing, training
from creditspark.workload import tables

from conftest import SF


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({
        "id": range(n), "a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": rng.normal(size=n),
        "split": rng.choice(["train", "validation", "test"], n, p=[0.6, 0.2, 0.2]),
    })
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * pdf.a - 0.7 * pdf.b))).astype(float)
    pdf.loc[pdf.index % 11 == 0, "a"] = None
    return spark.createDataFrame(pdf).replace(float("nan"), None).persist()


def parts(data):
    return [data.filter(F.col("split") == s) for s in ("train", "validation", "test")]


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("kind,options", [
    ("logistic", {}), ("gbt", {"maxIter": 5, "maxDepth": 3}), ("random_forest", {"numTrees": 5, "maxDepth": 4})])
def test_saved_model_scores_the_same(spark, data, tmp_path, kind, options):
    train, valid, test = parts(data)
    model = training.fit_calibrated(train, valid, FEATURES, kind, **options)
    training.save_model(model, str(tmp_path / kind))
    again = training.load_model(str(tmp_path / kind))
    a, b = (training.score(m, test).select("id", "pd").orderBy("id").toPandas() for m in (model, again))
    assert np.allclose(a.pd, b.pd) and a.pd.between(0, 1).all()


def test_comparison_beats_chance(spark, data):
    models, table = training.train_evaluate(data, FEATURES, ("logistic", "random_forest"), {"random_forest": {"numTrees": 5}})
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == set(models) and all(r.auc_test > 0.6 and abs(r.gini_val - (2 * r.auc_val - 1)) < 1e-12 for r in rows.values())
    assert training.best_model(table).first().model in rows


def test_single_class_is_refused(data):
    with pytest.raises(ValueError, match="single class"):
        training.fit_base(data.filter("label = 0"), FEATURES, "logistic")


def pool_adjacent(y, w):
    blocks = []
    for value, weight in zip(y, w):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, k, n = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * k) / (last[1] + k)
            last[1] += k
            last[2] += n
    return np.concatenate([[b[0]] * b[2] for b in blocks])


def test_isotonic_pools_ties_and_clips(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"p": rng.integers(0, 30, 900) / 30, "y": 0})
    pdf["y"] = (rng.random(900) < pdf.p * 0.6 + 0.1).astype(int)
    t = pdf.groupby("p").y.agg(["mean", "count"])
    want = pool_adjacent(t["mean"], t["count"])
    model = training.fit_isotonic(spark.createDataFrame(pdf), "y", "p")
    got = model.transform(spark.createDataFrame(pd.DataFrame({"p": t.index}))).orderBy("p").toPandas()
    assert np.allclose(got.pd, want)
    ends = model.transform(spark.createDataFrame([(-1.0,), (2.0,)], "p double")).orderBy("p").toPandas()
    assert np.allclose(ends.pd, [want[0], want[-1]])


@pytest.mark.parametrize("mode", ["small", "large"])
def test_medians(request, spark, data, mode):
    request.getfixturevalue(mode)
    pdf = data.toPandas()
    got = preprocessing.fit_medians(data.withColumn("none", F.lit(None).cast("double")), ["a", "b", "none"])
    assert got["none"] is None and np.allclose([got["a"], got["b"]], [pdf.a.median(), pdf.b.median()])


# --- Shapley values ---------------------------------------------------------


def tree_value(x, known, leaves):
    total = 0.0
    for value, steps in leaves:
        weight = 1.0
        for f, low, high, share in steps:
            weight *= (low < x[f] <= high) if f in known else share
        total += value * weight
    return total


def shapley_by_subsets(x, leaves):
    d = len(x)
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            for s in combinations(rest, size):
                w = factorial(size) * factorial(d - size - 1) / factorial(d)
                out[i] += w * (tree_value(x, {*s, i}, leaves) - tree_value(x, set(s), leaves))
    return out


def test_tree_contributions(spark, data, tmp_path):
    train, valid, test = parts(data)
    model = training.fit_calibrated(train, valid, FEATURES, "gbt", maxIter=4, maxDepth=4)
    leaves = explain.tree_leaves(model, str(tmp_path / "trees"))
    filled = test.limit(20).na.fill(training.MISSING).select(*FEATURES).toPandas().to_numpy(float)
    values, base = explain.tree_contributions(filled, leaves)
    for row, x in zip(values, filled):
        assert np.allclose(row, shapley_by_subsets(x, leaves))
    out = explain.shap_values(model, test, str(tmp_path / "again"), keep=["id"]).toPandas().set_index("id")
    raw = training.score(model, test, raw="raw").select("id", "raw").toPandas().set_index("id").raw
    margin = out.shap.map(sum) + out.base
    assert np.allclose(np.log(raw / (1 - raw)), margin.loc[raw.index])
    importance = explain.shap_importance(explain.shap_values(model, test, str(tmp_path / "third")), FEATURES)
    assert {r.variable for r in importance.collect()} == set(FEATURES)
    assert abs(sum(r.gain for r in explain.gain_importance(model).collect()) - 1) < 1e-9


def test_linear_contributions_add_up(spark, data):
    train, valid, test = parts(data)
    model = training.fit_calibrated(train, valid, FEATURES, "logistic")
    out = explain.linear_contributions(model, test).select("id", "shap", "base").toPandas().set_index("id")
    raw = training.score(model, test, raw="raw").select("id", "raw").toPandas().set_index("id").raw
    assert np.allclose(np.log(raw / (1 - raw)), (out.shap.map(sum) + out.base).loc[raw.index])


def test_levels_of_the_panel(spark):
    found = tables.levels(spark, SF)
    assert found["loan_purpose"] == ["C", "N", "P"] and found["amortization_type"] == ["ARM", "FRM"]


def test_logistic_coefficients_are_where_the_penalised_loss_is_flat(spark, data):
    """The gradient of the weighted, penalised loss at the fitted coefficients, computed anew from the stored rows."""
    train = parts(data)[0]
    model = training.fit_base(train, FEATURES, "logistic", tol=1e-9)
    rows = model.transform(train.select("label", *FEATURES)).select("label", "features").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    filled = train.select(*FEATURES).toPandas()
    filled = filled.fillna(filled.median())
    assert np.allclose(np.sort(x, axis=0), np.sort(((filled - filled.mean()) / filled.std(ddof=0)).to_numpy(), axis=0))
    n, positive = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive)))
    fit = model.stages[-1]
    coefficients = fit.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ coefficients + fit.intercept)))
    penalty = coefficients / (training.INVERSE_REGULARIZATION * n)
    gradient = (weight * (p - y)) @ x / weight.sum() + penalty
    assert np.abs(gradient).max() < 1e-5 and abs((weight * (p - y)).sum() / weight.sum()) < 1e-5
    assert np.abs((weight * (0.5 - y)) @ x / weight.sum()).max() > 1e-2  # at zero it is not flat


def test_few_files_are_fitted_on_all_cores(spark, data, tmp_path):
    data.coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    spread = training._spread(one)
    assert one.rdd.getNumPartitions() == 1 and spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread.count() == one.count()


def test_comparison_equals_sql_on_the_stored_scores(spark, data, tmp_path):
    import duckdb

    models, _ = training.train_evaluate(data, FEATURES, ("logistic", "random_forest"), {"random_forest": {"numTrees": 5}})
    training.scored_parts(models, data, FEATURES).write.parquet(str(tmp_path / "scores"))
    want = duckdb.sql(f"""
WITH s AS (SELECT * FROM '{tmp_path}/scores/*.parquet'),
ranked AS (SELECT *, rank() OVER (PARTITION BY model, split ORDER BY pd) + (count(*) OVER (PARTITION BY model, split, pd) - 1) / 2 AS r FROM s)
SELECT model, split, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc,
  avg((pd - label) * (pd - label)) AS brier
FROM ranked GROUP BY 1, 2""").fetchall()
    got = {r.model: r for r in training.comparison(spark.read.parquet(str(tmp_path / "scores"))).collect()}
    assert len(want) == 4
    for model, split, auc, brier in want:
        suffix = {"validation": "val", "test": "test"}[split]
        assert abs(got[model][f"auc_{suffix}"] - auc) < 1e-9 and abs(got[model][f"brier_{suffix}"] - brier) < 1e-9


def test_calibration_scores_each_row_once(spark):
    """A costly score is not evaluated again for the rows without one."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return None if x % 10 == 0 else x / 100

    df = spark.range(100, numPartitions=3).select((F.col("id") % 3 == 0).cast("double").alias("y"), costly("id").alias("p"))
    model = training.fit_isotonic(df, "y", "p")
    assert seen.value == 100 and model.boundaries.size > 0
