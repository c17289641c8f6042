import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.models import boosting as B

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 2000
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n).round(1), "b": rng.integers(0, 5, n).astype(float),
                        "c": rng.normal(size=n).round(1), "d": 1.0, "e": rng.integers(0, 40, n) / 4})
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * pdf.a * (pdf.b > 2) - 0.2 * pdf.e))).astype(int)
    pdf.loc[pdf.index % 9 == 0, "a"] = None
    return pdf, spark.createDataFrame(pdf).replace(float("nan"), None).persist()


EDGES = [[-999.0, -1.0, -0.5, 0.0, 0.5, 1.0], [0.0, 1.0, 2.0, 3.0], [-1.0, 0.0, 1.0], [], [1.0, 3.0, 5.0, 7.0, 9.0]]


def brute_tree(x, g, h, depth):
    """Every split of every node by looking at its rows; leaf values per row."""
    out = np.zeros(len(g))

    def grow(rows, left):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left:
            for f, edges in enumerate(EDGES):
                for e in edges:
                    l, r = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if h[l].sum() < 1 or h[r].sum() < 1:
                        continue
                    gain = 0.5 * (g[l].sum() ** 2 / (h[l].sum() + 1) + g[r].sum() ** 2 / (h[r].sum() + 1) - gs ** 2 / (hs + 1))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, l, r)
        if best[1] is None:
            out[rows] = -0.05 * gs / (hs + 1)
        else:
            grow(best[1], left - 1)
            grow(best[2], left - 1)

    grow(np.arange(len(g)), depth)
    return out


@pytest.mark.parametrize("trees,depth,every", [(1, 5, 25), (5, 3, 2)])
def test_trees_equal_brute_force(spark, data, trees, depth, every):
    pdf, df = data
    model = B.fit_boosted(df, FEATURES, edges=EDGES, trees=trees, depth=depth, row_share=1.0, column_share=1.0, every=every)
    x, y = pdf[FEATURES].fillna(-999.0).to_numpy(), pdf.label.to_numpy()
    w = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + brute_tree(x, w * (p - y), w * p * (1 - p), depth)
    got = model.score(df).select("id", "pd").toPandas().set_index("id").pd.sort_index()
    assert np.allclose(got, 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_samples_per_tree_and_layout(spark, data, tmp_path):
    _, df = data
    edges = B.quantile_edges(df, FEATURES, 32)
    fit = lambda t: B.fit_boosted(t, FEATURES, keys=["id"], trees=12, depth=4, every=5, edges=edges)
    model, again = fit(df), fit(df.repartition(7, "c"))
    for one, other in zip(model.trees, again.trees):
        assert (one.feature == other.feature).all() and (one.bin == other.bin).all() and np.allclose(one.value, other.value)
        assert len(set(one.feature[one.feature >= 0])) <= 4
    assert len({tuple(sorted(set(t.feature))) for t in model.trees}) > 1  # the columns differ between trees
    assert 3 not in {f for t in model.trees for f in t.feature}  # one value only
    shares = [B._sampled(np.random.default_rng(0).integers(-2**63, 2**63 - 1, 20_000), t, 0.8).mean() for t in range(5)]
    assert all(abs(s - 0.8) < 0.02 for s in shares)
    model.save(spark, str(tmp_path / "m"))
    held = B.Boosted.load(spark, str(tmp_path / "m"))
    a, b = (m.score(df).orderBy("id").toPandas().pd for m in (model, held))
    assert (a == b).all() and abs(sum(s for _, s in model.gain_importance()) - 1) < 1e-9


def test_more_trees_fit_better(data):
    pdf, df = data
    model = B.fit_boosted(df, FEATURES, trees=30, depth=3, rate=0.3)
    scored = model.score(df).toPandas()
    ranks = scored.pd.rank()
    ones = scored.label == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.75 and model.gain_importance()[0][1] > 0.2


def test_defined_cases(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="single class"):
        B.fit_boosted(df.filter("label = 0"), FEATURES)
    with pytest.raises(ValueError, match="single class"):
        B.fit_boosted(df.limit(0), FEATURES)
    some = df.withColumn("label", F.when(F.col("id") % 7 > 0, F.col("label"))).withColumn("bins", F.lit("x")).withColumn("f0", F.lit(1))
    model = B.fit_boosted(some, ["a", "d"], trees=2, depth=2)
    out = model.score(some)
    assert out.columns == [*some.columns, "pd"] and out.filter("pd between 0 and 1").count() == 2000
