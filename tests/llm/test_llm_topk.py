import math
import random

import pytest

from creditspark.llm import topk as T


def brute(rows, every, k):
    clean = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in clean:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in clean if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,bins,chunk", [(2048, 1024, 1024), (3, 4, 7)])
def test_against_brute_force(spark, monkeypatch, block, bins, chunk):
    monkeypatch.setattr(T, "BINS", bins)
    monkeypatch.setattr(T, "CHUNK", chunk)
    rng = random.Random(block)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, same if i % 3 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.3]), (202, [float("nan")] * 4), (203, [float("inf"), 0, 0, 0]), (None, same), (210, []), (220, [1.0, 2.0]),
             (3, rows[4][1]), (230, [0.0] * 4), (20, rows[20][1]), (240, [-3.0] * 4)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(map(tuple, T.search(df, 10, 5, block).collect())) == brute(rows, 10, 5)


def test_large_components_fewer_candidates_and_empty(spark):
    rows = [(0, [2.0**20, 3.0]), (1, [2.0**21, -1.0]), (2, [-(2.0**20), 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, T.search(df, 2, 5).collect())) == brute(rows, 2, 5)
    assert T.search(df.limit(0)).collect() == [] and T.search(df.where("vec_id = 0"), 2).collect() == []


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [2.0**24]), (1, [-(2.0**24)])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        T.search(df, 2, 5)
    assert sorted(map(tuple, T.search(df.selectExpr("vec_id", "transform(embedding, x -> x / 8) AS embedding"), 1, 5, 1).collect())) == [
        (0, 1, 1, -(2**58)), (1, 1, 0, -(2**58))]
