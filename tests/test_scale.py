import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.functions.binning import equal_width_histogram, quantile_bins
from creditspark.operators import sampling, validation
from creditspark import scale
from creditspark.scale import quantiles, running_totals


def scored(n=3000, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 40, n) / 40 if ties else rng.random(n)
    y = (rng.random(n) < 0.1 + 0.5 * p).astype(int)
    return pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", "b", "b"], n), "y": y, "p": p})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.replace(float("nan"), None) if "p" in pdf else df


BOTH = pytest.mark.parametrize("mode", ["small", "large"])


@pytest.fixture
def chosen(request, mode):
    request.getfixturevalue(mode)


@BOTH
def test_quantiles_match_linear_interpolation(spark, mode, chosen):
    pdf = scored(ties=False)
    pdf.loc[pdf.index % 17 == 0, "p"] = None
    probs = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    got = {r.g: r for r in quantiles(frame(spark, pdf), "p", probs, ["g"], aggs=[F.count("p").alias("n")]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g].q, part.p.dropna().quantile(probs))
        assert got[g].n == part.p.count()
    whole = quantiles(frame(spark, pdf), "p", probs).first().q
    assert np.allclose(whole, pdf.p.dropna().quantile(probs))


@BOTH
def test_quantiles_of_a_group_without_values(spark, mode, chosen):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    assert {r.g: r.q for r in quantiles(df, "v", [0.5], ["g"]).collect()} == {"a": [1.0], "b": None}


@BOTH
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, mode, chosen, descending):
    pdf = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 100, "v": list(range(900)) + list(range(100)), "n": 1})
    out = running_totals(frame(spark, pdf), "v", ["n"], ["g"], descending).toPandas()
    rank = out.groupby("g").v.rank(ascending=not descending)
    assert (out.cum_n == rank).all()
    assert (out.all_n == out.g.map({"a": 900, "b": 100})).all()


@BOTH
def test_bins_collapse_tied_edges(spark, mode, chosen):
    pdf = scored(400)
    pdf.loc[pdf.index < 300, "p"] = 0.25
    got = quantile_bins(frame(spark, pdf), "p").toPandas().sort_values("id")
    want = pd.qcut(pdf.p, 10, labels=False, duplicates="drop") + 1
    assert (got.bin.to_numpy() == want.to_numpy()).all()


def auc_by_pairs(y, p):
    pos, neg = p[y == 1].to_numpy(), p[y == 0].to_numpy()
    more = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return more / (len(pos) * len(neg))


@BOTH
def test_discrimination_with_ties_per_group(spark, mode, chosen):
    pdf = scored(1200)
    got = validation.discrimination(frame(spark, pdf), "y", "p", ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        auc = auc_by_pairs(part.y, part.p)
        cuts = np.unique(part.p)
        ks = max((part.p[part.y == 1] >= c).mean() - (part.p[part.y == 0] >= c).mean() for c in cuts)
        assert np.isclose(got.auc[g], auc) and np.isclose(got.gini[g], 2 * auc - 1)
        assert np.isclose(got.ks[g], max(ks, 0))


@BOTH
def test_stability_index(spark, mode, chosen):
    pdf = scored(2000)
    pdf.loc[(pdf.id < 1000) & (pdf.index % 2 == 0), "p"] = 0.5
    ref, new = pdf.p[pdf.id < 1000], pdf.p[pdf.id >= 1000]
    edges = np.percentile(ref, np.linspace(0, 100, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    # Counting by hand keeps tied edges as empty bins.
    share = lambda x: np.clip(np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=10) / len(x), 1e-6, None)
    a, b = share(ref), share(new)
    got = validation.psi(frame(spark, pdf), "p", F.col("id") < 1000).first()
    assert np.isclose(got.psi, ((b - a) * np.log(b / a)).sum())
    assert got.empty_bins == (a == 1e-6).sum()


def test_hosmer_lemeshow_tail(spark):
    df = spark.createDataFrame([(15.507,)], "x double")
    assert abs(df.select(validation.chi2_survival_even(F.col("x"), 8)).first()[0] - 0.05) < 1e-4
    pdf = scored(1000, ties=False)
    g = pd.qcut(pdf.p, 10, labels=False)
    t = pdf.groupby(g).agg(n=("y", "count"), o=("y", "sum"), e=("p", "sum"))
    want = ((t.o - t.e) ** 2 / (t.e * (1 - t.e / t.n))).sum()
    assert np.isclose(validation.hosmer_lemeshow(frame(spark, pdf), "y", "p").first().hl, want)


def test_backtest_identity(spark):
    pdf = scored(800)
    table = validation.backtest_deciles(frame(spark, pdf), "y", "p").toPandas()
    assert table.n.sum() == 800 and table.defaults.sum() == pdf.y.sum()
    assert np.allclose(table.difference, table.pd_predicted - table.pd_observed)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]], "v double")
    got = {r.bin: r.n for r in equal_width_histogram(df, "v", 5).collect()}
    assert got == dict(zip(range(1, 6), np.histogram([0, 1, 2, 3, 4, 5, 6, 7, 8, 10], 5)[0]))


@pytest.mark.parametrize("n", [0, 1, 100, 2999, 3000, 5000])
def test_sample_size_is_exact_and_layout_free(spark, n):
    pdf = scored()
    a = sampling.random_subsample(frame(spark, pdf), n, ["id"]).select("id")
    b = sampling.random_subsample(frame(spark, pdf.sample(frac=1, random_state=1)).repartition(5), n, ["id"]).select("id")
    ids = sorted(r.id for r in a.collect())
    assert len(ids) == min(n, 3000) and ids == sorted(r.id for r in b.collect())


def test_stratified_quota(spark):
    pdf = scored()
    got = sampling.stratified_sample(frame(spark, pdf), 500, ["id"], ["y"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {k: int(500 * v / 3000) for k, v in pdf.y.value_counts().items()}
    assert sampling.stratified_sample(frame(spark, pdf), 4000, ["id"], ["y"]).count() == 3000

@pytest.mark.parametrize("kind", ["heavy tail", "one value", "special", "narrow"])
def test_selected_quantiles_equal_percentile(spark, large, kind):
    spark.conf.set("spark.creditspark.chunkRows", "300")
    rng = np.random.default_rng(8)
    n = 3000
    values = {
        "heavy tail": np.exp(rng.normal(0, 40, n)), "one value": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)),
        "special": np.where(rng.random(n) < 0.2, np.inf, np.where(rng.random(n) < 0.2, -np.inf, rng.normal(size=n))),
        "narrow": 1e300 * rng.choice([-1.0, 1.0], n) + np.where(rng.random(n) < 0.5, 0, 5e-324)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 5, n), "v": values, "w": rng.integers(0, 4, n)}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    wanted = F.array(*[F.lit(p) for p in probs])
    for groups, frequency in ((["g"], None), ([], None), (["g"], "w")):
        got = quantiles(df, "v", probs, groups, frequency=frequency)
        want = df.groupBy(*groups).agg(F.percentile("v", wanted, F.col(frequency) if frequency else F.lit(1)).alias("q"))
        a, b = ({tuple(r)[:-1]: r.q for r in t.collect()} for t in (got, want))
        assert a.keys() == b.keys()
        assert all(np.allclose(a[k], b[k], rtol=1e-12, atol=0, equal_nan=True) for k in a)


def test_selection_shuffles_cells_not_values(spark, large, monkeypatch):
    """With chunks larger than what a cell holds, no pass groups by the value."""
    spark.conf.set("spark.creditspark.chunkRows", "2000")
    sizes, counted = [], scale.running_totals

    def watched(df, *args, **options):
        sizes.append(df.count())
        return counted(df, *args, **options)

    monkeypatch.setattr(scale, "running_totals", watched)
    df = spark.range(200_000).selectExpr("id * 0.37 AS v")
    assert quantiles(df, "v", [0.5]).first().q == [pytest.approx(0.37 * 199_999 / 2)]
    assert sum(sizes) <= 2000


@BOTH
def test_the_report_reads_the_rows_once(spark, tmp_path, mode, chosen):
    path = str(tmp_path / "t")
    frame(spark, scored()).withColumn("is_ref", F.col("id") % 3 == 0).write.parquet(path)
    report = validation.validation_report(spark.read.parquet(path), "y", "p", F.col("is_ref"), ["g"])
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()  # only the stored tallies are left
    assert {r.g for r in report.collect()} == {"a", "b"}
