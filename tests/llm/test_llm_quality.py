import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from creditspark.llm import quality as Q

DOCS = "doc_id long, text string, n_chars long, label string, score int"


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = Q.Machine(0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    x = rng.normal(size=(5, 12)).astype(np.float32)
    for row, score in zip(x.astype(float), m.score(x)):
        margin = m.intercept + row @ m.linear
        for i in range(12):
            for j in range(i):
                margin += m.factors[i] @ m.factors[j] * row[i] * row[j]
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-9


def test_held_out_accuracy_and_no_peeking(spark, monkeypatch):
    monkeypatch.setattr(Q, "STEPS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.quality_scores(docs, labels).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    seen = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert (seen.predicted == seen.quality).mean() > 0.95
    turned = labels.withColumn("quality", F.when(Q.crc_remainder("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    used = Q.labelled_sample(docs, turned).select("doc_id", "label").exceptAll(Q.labelled_sample(docs, labels).select("doc_id", "label"))
    assert used.isEmpty()


def test_nulls_repeats_extra_columns_and_few_labels(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "x", 1), (2, "", 0, "x", 1), (2, "", 0, "x", 1), (None, "some words", 10, None, None), (4, "w " * 200_000, 400_000, "y", 2)], DOCS)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality_scores(docs, empty).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {1}
    one = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert {r.predicted for r in Q.quality_scores(docs, one).collect()} == {0}
    assert Q.quality_scores(docs.limit(0), empty).collect() == []
    assert Q.keep_good(docs, empty).columns == docs.columns


def test_inputs_of_strange_texts():
    x = Q.inputs(pa.array([None, "", "\n\n", "é" * 50, "A!! " * 9]), np.array([np.nan, -1, 0, 5, 1e9]))
    assert np.isfinite(x).all() and np.array_equal(x[0], x[1])
