import numpy as np
import pandas as pd
import pytest

from creditspark.models.isotonic import calibrate, isotonic_blocks
from test_models import pool_adjacent


def fitted_values(blocks, scores):
    return [next(b.pd for b in blocks if b.low <= s <= b.high) for s in scores]


def made(shape, n=900, seed=3):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 150, n) / 150
    y = {"noise": rng.random(n) < 0.3, "rising": rng.random(n) < p ** 3, "falling": rng.random(n) < 1 - p, "all": p > 2,
         "steps": np.where(p < 0.5, p > 0.25, p > 0.75)}[shape]
    return pd.DataFrame({"p": p, "y": np.asarray(y).astype(int)})


@pytest.mark.parametrize("mode", ["small", "large"])
@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "all", "steps"])
def test_blocks_are_those_of_pooling_adjacent_violators(request, spark, mode, shape):
    request.getfixturevalue(mode)
    pdf = made(shape)
    t = pdf.groupby("p").y.agg(["mean", "count"])
    blocks = sorted(isotonic_blocks(spark.createDataFrame(pdf), "y", "p").collect(), key=lambda b: b.low)
    assert sum(b.n for b in blocks) == len(pdf) and all(a.high < b.low and a.pd < b.pd for a, b in zip(blocks, blocks[1:]))
    assert np.allclose(fitted_values(blocks, t.index), pool_adjacent(t["mean"], t["count"]))


@pytest.mark.parametrize("mode", ["small", "large"])
def test_calibration_is_linear_between_blocks_and_flat_outside(request, spark, mode):
    request.getfixturevalue(mode)
    blocks = isotonic_blocks(spark.createDataFrame(made("rising")), "y", "p")
    ends = sorted((x, b.pd) for b in blocks.collect() for x in {b.low, b.high})
    asked = [-1.0, 0.0, 0.1234, 0.5, 0.5, 0.777, 0.9999, 2.0, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(asked)], "id int, p double")
    got = {r.id: r.calibrated for r in calibrate(df, blocks, "p", "calibrated").collect()}
    want = np.interp([s for s in asked if s is not None], *zip(*ends))
    assert len(got) == len(asked) and got[8] is None and np.allclose([got[i] for i in range(8)], want)


@pytest.mark.parametrize("mode", ["small", "large"])
def test_empty_and_missing(request, spark, mode):
    request.getfixturevalue(mode)
    df = spark.createDataFrame([(None, 1), (0.5, None)], "p double, y int")
    blocks = isotonic_blocks(df, "y", "p")
    assert blocks.collect() == [] and [r.pd for r in calibrate(df, blocks, "p").collect()] == [None, None]
    one = isotonic_blocks(spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int"), "y", "p")
    assert [tuple(r) for r in one.collect()] == [(0.5, 0.5, 0.5, 2)]


def test_many_chunks_keep_few_numbers_on_the_driver(spark, large):
    """A convex curve: every score is a block of its own, none of them is gathered."""
    rows = [(i, 1 if j <= i // 3 else 0) for i in range(60) for j in range(21)]
    blocks = isotonic_blocks(spark.createDataFrame(rows, "p int, y int"), "y", "p").collect()
    assert sorted((b.low, b.high, round(b.pd, 9)) for b in blocks) == [(3 * k, 3 * k + 2, round((k + 1) / 21, 9)) for k in range(20)]
