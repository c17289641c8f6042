"""Quality scores by a factorisation machine.

Inputs are hashed words, structure statistics and the declared length of the text.  The
machine learns one weight and a short vector per input; a pair of inputs interacts by the
dot product of their vectors.  The sum over all pairs is

    1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

so that a text is scored in time linear in its inputs.

Defined cases: a null text counts as empty; an empty text gets the score of a text without words and is
scored like any other; repeated rows are scored each; extra columns are ignored; if the
labelled rows hold fewer than two classes, every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import words as W
from creditspark.llm.common import crc_remainder, pieces, text_buffer

#: Word inputs; each word counts for the input that its name falls into.
BUCKETS = 512
#: Length of an input's vector.
FACTORS = 4
#: Labelled rows the fit reads at most, chosen by a hash of the id.
FIT_ROWS = 8_000
STEPS = 60
_WORD_PART = 0.5

STRUCTURE = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "space", "marks", "symbols", "bars", "shouts",
    "other", "fresh_words", "echo", "fresh_lines", "line_words", "declared",
)


def _class_table() -> np.ndarray:
    """Per byte: 1 upper, 2 digit, 3 white space, 4 usual mark, 5 symbol, 6 bar, 7 '!' or '?', 8 non-ASCII, 0 rest."""
    table = np.zeros(256, np.uint8)
    for kind, chars in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\f\v", b".,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b"!?"),
        1,
    ):
        table[np.frombuffer(chars, np.uint8)] = kind
    table[128:] = 8
    return table


_CLASSES = _class_table()


def _line_stats(text: bytes) -> tuple[float, float]:
    lines = [x for x in text.split(b"\n") if x]
    return (len(set(lines)) / len(lines), len(lines)) if lines else (1.0, 0.0)


def inputs(texts: pa.Array, declared: np.ndarray) -> np.ndarray:
    """One row of inputs per text: the structure statistics, then the word buckets.

    `declared` is the metadata length of each text (not a number where unknown).
    """
    raw, raw_at = text_buffer(texts)
    names, at = W.words(*W.lowered(texts))
    rows = len(raw_at) - 1
    out = np.zeros((rows, len(STRUCTURE) + BUCKETS), np.float32)
    kinds = _CLASSES[raw]
    slots = (names >> np.uint64(40)) % np.uint64(BUCKETS)
    known = np.nan_to_num(np.maximum(declared, 0.0), nan=0.0)
    for i in range(rows):
        a, b, p, q = raw_at[i], raw_at[i + 1], at[i], at[i + 1]
        n, w = int(b - a), int(q - p)
        share = np.bincount(kinds[a:b], minlength=9) / max(n, 1)
        mine = names[p:q]
        fresh, lines = _line_stats(raw[a:b].tobytes())
        out[i, :len(STRUCTURE)] = (
            np.log1p(n) / 12, np.log1p(w) / 10, min(n / max(w, 1), 40) / 10, share[1], share[2], share[3], share[4],
            min(5 * share[5], 1), min(5 * share[6], 1), min(5 * share[7], 1), share[8], len(np.unique(mine)) / max(w, 1),
            np.count_nonzero(mine[1:] == mine[:-1]) / max(w, 1), fresh, np.log1p(w / max(lines, 1)) / 8,
            np.log1p(known[i]) / 12,
        )
        if w:
            counts = np.sqrt(np.bincount(slots[p:q].astype(np.int64), minlength=BUCKETS))
            out[i, len(STRUCTURE):] = _WORD_PART * counts / np.linalg.norm(counts)
    return out


@dataclass(frozen=True)
class Machine:
    """A fitted machine: intercept, one weight per input, one vector per input."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        sums = x @ self.factors
        squares = (x * x) @ (self.factors * self.factors)
        margin = self.intercept + x @ self.linear + 0.5 * (sums * sums - squares).sum(1)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def _declared(batch: pa.RecordBatch) -> np.ndarray:
    if "n_chars" not in batch.schema.names:
        return np.full(batch.num_rows, np.nan)
    return np.asarray(batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def _source(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, hold_out: bool = True) -> DataFrame:
    """At most `rows` labelled documents with a 0/1 column `label`; repeated labels of a document go by majority.

    With `hold_out`, rows whose crc32(id) modulo 3 is 1 are never used.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)")
    if hold_out:
        known = known.where(crc_remainder("doc_id") != 1)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(*_source(docs)).join(F.broadcast(known), "doc_id")  # bounded by `rows`


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, hold_out: bool = True) -> Machine:
    sample = labelled_sample(docs, labels, rows, hold_out)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            x = inputs(b.column("text"), _declared(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(list(x), pa.list_(pa.float32()))], ["label", "x"])

    points = sample.mapInArrow(vectors, "label double, x array<float>").select(
        "label", array_to_vector("x").alias("features")).repartition(6).persist()
    size = len(STRUCTURE) + BUCKETS
    try:
        seen = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
        if len(seen) < 2:
            share = 0.5 if not seen else min(max(next(iter(seen)), 1e-6), 1 - 1e-6)
            return Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, 1)))
        model = FMClassifier(
            featuresCol="features", labelCol="label", factorSize=FACTORS, maxIter=STEPS, stepSize=0.1,
            regParam=1e-5, initStd=0.05, tol=1e-7, seed=7,
        ).fit(points)
        return Machine(float(model.intercept), model.linear.toArray(), model.factors.toArray())
    finally:
        points.unpersist()


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`; one pass, no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            s = machine.score(inputs(b.column("text"), _declared(b)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*_source(docs)).mapInArrow(scored, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(crc_remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out third and score every document."""
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose score is 0.5 or more.  One pass, no join on the id."""
    machine = fit(docs, labels)
    columns = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            keep = machine.score(inputs(b.column("text"), _declared(b))) >= 0.5
            yield b.filter(pa.array(keep)).select(columns)

    return docs.mapInArrow(kept, docs.schema)
