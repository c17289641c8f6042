"""Gradient-boosted trees with second-order splits, subsampled rows and columns sampled per tree.

Features are read once into bins at quantile edges, one byte per feature.  Every level of a tree is one aggregate: tasks add
the gradients and curvatures of their rows per (open node, feature, bin), Spark sums these cells over the tasks, and the driver picks the
splits from at most 2^depth x features x bins sums.  All training rows take part.  They are stored in blocks, one row of the
table for some thousand training rows with the bins feature by feature, so that Spark handles few rows and numpy long columns.  After
`every` trees the blocks are stored again with their margins, so a pass walks few trees and a lost executor costs one re-read.

Defined cases: missing values and NaN become `missing` and are split like any value; a feature with one value is never split on; rows without label
are left out; one class only, or no rows, is an error.  Whether a row is in a tree's subsample depends on its key alone, so the
layout of the table changes nothing but the order in which sums are rounded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from creditspark.scale import input_bytes, scratch_dir

# Model parameters.
TREES, DEPTH, RATE, ROW_SHARE, COLUMN_SHARE, SEED, MISSING = 500, 5, 0.05, 0.8, 0.8, 42, -999.0
#: Penalty of leaf values, least curvature of a child, least gain of a split.
PENALTY, CHILD_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Bins per feature by default, 256 at most.
BINS = 64
#: Stored bytes per core below which rows are spread over all cores; a task has LEAST_ROWS or more.
TASK_BYTES, LEAST_ROWS = 32 * 1024 * 1024, 2_000
_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Training rows of a block, and blocks that Spark hands to a Python worker at once.
BLOCK, BLOCKS_AT_ONCE = 16_384, 8
#: Columns of n values each: keys (8 bytes), labels (8), bins (1 for each feature and row, feature by feature), margins (8).
_BLOCKS = "key binary, label binary, bins binary, margin binary"


@dataclass
class Tree:
    """Nodes in heap order: split feature (-1 for a leaf), largest bin of the left side, value of the leaf, gain of the split."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n))

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node at which every row of bins ends; the bins lie row by row or feature by feature."""
        flat, (by_row, by_feature) = bins.ravel("K"), bins.strides  # of single bytes
        row, node = np.arange(len(bins)) * by_row, np.zeros(len(bins), int)
        for level in range(len(self.feature).bit_length() - 1):
            if (self.feature[2 ** level - 1:2 ** (level + 1) - 1] < 0).all():
                break
            feature = self.feature.take(node)
            right = flat.take(row + np.maximum(feature, 0) * by_feature) > self.bin.take(node)
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    missing: float = MISSING

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.walk(bins)] for t in self.trees), np.zeros(len(bins)))

    def score(self, df: DataFrame, name: str = "pd") -> DataFrame:
        """`df` with the probability of label 1."""
        held = df.sparkSession.sparkContext.broadcast(self)  # bounded by trees, nodes and bins

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            model = held.value
            return pd.Series(1 / (1 + np.exp(-model.margins(binned(x.to_numpy(float), model.edges, model.missing)))))

        return df.withColumn(name, probability(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])))

    def gain_importance(self) -> list[tuple[str, float]]:
        """Mean gain of the splits on each feature as a share of all, largest first."""
        used = np.concatenate([t.feature for t in self.trees])
        gains = np.concatenate([t.gain for t in self.trees])
        mean = [gains[used == i].mean() if (used == i).any() else 0.0 for i in range(len(self.features))]
        total = sum(mean) or 1.0
        return sorted(((f, float(m / total)) for f, m in zip(self.features, mean)), key=lambda r: (-r[1], r[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a new path."""
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]
        spark.createDataFrame([(json.dumps(vars(self) | {"trees": trees}),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        held = json.loads(spark.read.text(path).first()[0])
        return cls(**held | {"trees": [Tree(**{k: np.array(v) for k, v in t.items()}) for t in held["trees"]]})


def binned(values: np.ndarray, edges: Sequence[Sequence[float]], missing: float) -> np.ndarray:
    """The number of edges below each value, as one byte."""
    filled = np.where(np.isnan(values), missing, values)
    return np.stack([np.searchsorted(e, filled[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = BINS, missing: float = MISSING) -> list[list[float]]:
    """Upper ends of the bins of all features, in one aggregate of sketches."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    filled = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(missing)), F.lit(missing)) for c in features]
    row = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"e{i}") for i, v in enumerate(filled)],
                 *[F.max(v).alias(f"m{i}") for i, v in enumerate(filled)]).first()
    return [[e for e in sorted(set(row[f"e{i}"] or [])) if e < row[f"m{i}"]] for i in range(len(features))]


def _block(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels, bins (rows by features) and margins of a block, read from the columns' own bytes."""
    key, label, bins, margin = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in
                                (("key", np.int64), ("label", float), ("bins", np.uint8), ("margin", float)))
    return key, label, bins.reshape(width, len(key)).T, margin


def _sampled(keys: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether the rows of these keys are in the tree's subsample (a mixing step of 64-bit hashes)."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) < share * 2.0 ** 53


def _table(df, features, label, keys, edges, missing, block=BLOCK):
    """Rows as _BLOCKS of `block` rows: the key that the subsamples look at, the label, the bins, a margin of 0."""
    key = F.xxhash64(*(keys or [label, *features]))
    rows = df.filter(F.col(label).isNotNull()).select(
        key.alias("key"), F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])

    def made(held: list) -> pa.RecordBatch:
        numbers, y, x = (np.concatenate(p) for p in zip(*held))
        parts = (numbers, y, np.ascontiguousarray(x.T), np.zeros(len(y)))
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["key", "label", "bins", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, len(batch), block):
                b = batch.slice(start, block)
                x = np.stack([b.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
                held.append((b.column("key").to_numpy(), b.column("label").to_numpy(), binned(x, edges, missing)))
                n += len(b)
                if n >= block:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return rows.mapInArrow(run, _BLOCKS)


def cells(rows: DataFrame, model: Boosted, pending: Sequence[Tree], tree: Tree, level: int, columns: Sequence[int],
          number: int, row_share: float, positive: float) -> dict[str, np.ndarray]:
    """Sums of gradient and curvature per (node of the level, column, bin), as arrays of that shape."""
    width, start, n_nodes = len(model.features), 2 ** level - 1, 2 ** level
    n_bins = max(map(len, model.edges)) + 1
    shape, chosen, base = (n_nodes, len(columns), n_bins), np.array(columns), model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sum, h_sum = np.zeros(shape), np.zeros(shape)
        size = n_nodes * n_bins
        for batch, i in ((b, i) for b in batches for i in range(len(b))):
            key, y, bins, margin = _block(batch, i, width)
            used = _sampled(key, number, row_share)
            node = tree.walk(bins) - start
            used = np.flatnonzero(used & (node >= 0))
            margin = base + margin + sum(t.value[t.walk(bins)] for t in pending)
            y, at = y[used], node[used] * n_bins
            p, w = 1 / (1 + np.exp(-margin[used])), np.where(y == 1, positive, 1.0)
            g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-16)
            for k, c in enumerate(chosen):
                cell = at + bins[:, c].take(used)
                g_sum[:, k] += np.bincount(cell, g, size).reshape(n_nodes, n_bins)
                h_sum[:, k] += np.bincount(cell, h, size).reshape(n_nodes, n_bins)
        g_sum, h_sum = g_sum.ravel(), h_sum.ravel()
        full = np.flatnonzero(h_sum)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(g_sum[full]), pa.array(h_sum[full])], ["cell", "g", "h"])

    found = rows.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = {}
    for name in ("g", "h"):
        whole = np.zeros(np.prod(shape))
        whole[found["cell"].to_numpy()] = found[name].to_numpy()
        out[name] = whole.reshape(shape)
    return out


def split_gains(sums: dict[str, np.ndarray], penalty: float = PENALTY, child_weight: float = CHILD_WEIGHT):
    """Gain of a split after every bin (-inf where not allowed) and the sums of the left sides, by node and column."""
    left = {k: np.cumsum(v, 2) for k, v in sums.items()}
    g, h = left["g"][:, :, -1:], left["h"][:, :, -1:]
    gl, hl = left["g"], left["h"]
    gr, hr = g - gl, h - hl
    gain = 0.5 * (gl ** 2 / (hl + penalty) + gr ** 2 / (np.maximum(hr, 0) + penalty) - g ** 2 / (h + penalty))
    return np.where((hl >= child_weight) & (hr >= child_weight), gain, -np.inf), left


def _grow(rows, model, pending, number, columns, depth, rate, row_share, positive, penalty, child_weight) -> Tree:
    tree = Tree.empty(depth)
    leaf = lambda g, h: -rate * g / (h + penalty)
    for level in range(depth):
        sums = cells(rows, model, pending, tree, level, columns, number, row_share, positive)
        gains, left = split_gains(sums, penalty, child_weight)
        for i in range(2 ** level):
            node = 2 ** level - 1 + i
            g, h = left["g"][i, 0, -1], left["h"][i, 0, -1]
            if not h:
                continue
            best = gains[i].max()
            if level == 0:
                tree.value[node] = leaf(g, h)
            if not best > LEAST_GAIN:
                continue
            # the first of equal gains, whatever the order of the sums
            c, b = np.unravel_index(np.argmax(gains[i] >= best * (1 - 1e-9)), gains[i].shape)
            gl, hl = left["g"][i, c, b], left["h"][i, c, b]
            tree.feature[node], tree.bin[node], tree.gain[node], tree.value[node] = columns[c], b, best, 0.0
            tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(gl, hl), leaf(g - gl, h - hl)
        if (tree.feature[2 ** level - 1:2 ** (level + 1) - 1] < 0).all():
            break
    return tree


def root_splits(
    train: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], label: str = "label", positive: float = 1.0,
) -> DataFrame:
    """The best first split of each feature that has one: variable, split (rows up to it go left), gain."""
    model = Boosted(list(features), [list(map(float, e)) for e in edges])
    rows = _table(train, features, label, (), model.edges, model.missing, LEAST_ROWS)
    gains, _ = split_gains(cells(rows, model, [], Tree.empty(1), 0, range(len(features)), 0, 1.0, positive))
    best = [(f, e, g) for f, e, g in zip(features, model.edges, gains[0]) if np.isfinite(g).any()]
    found = [(f, e[int(np.argmax(g >= g.max() - 1e-9 * abs(g.max())))], float(g.max())) for f, e, g in best]
    return train.sparkSession.createDataFrame(found, "variable string, split double, gain double")


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fit_boosted(
    train: DataFrame, features: Sequence[str], label: str = "label", keys: Sequence[str] = (), trees: int = TREES,
    depth: int = DEPTH, rate: float = RATE, row_share: float = ROW_SHARE, column_share: float = COLUMN_SHARE,
    edges: Sequence[Sequence[float]] | None = None, positive: float | None = None, base: float = 0.0,
    penalty: float = PENALTY, child_weight: float = CHILD_WEIGHT, seed: int = SEED, every: int = 5,
) -> Boosted:
    """Boosted trees of the logistic loss on all rows; `positive` weighs label 1 (default: rows of 0 per row of 1)."""
    spark = train.sparkSession
    counts = train.agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros")).first()
    if any(len(e) >= 256 for e in edges or []):
        raise ValueError("a feature has more than 256 bins")
    if not counts.ones or not counts.zeros:
        raise ValueError("the training rows hold a single class")
    positive = counts.zeros / counts.ones if positive is None else positive
    model = Boosted(list(features), [list(map(float, e)) for e in edges or quantile_edges(train, features)], [], base)
    draw, folder = np.random.default_rng(seed), f"{scratch_dir(spark)}/boosting-{uuid.uuid4().hex}"
    n_columns = max(1, int(column_share * len(features)))
    cores, n = spark.sparkContext.defaultParallelism, counts.ones + counts.zeros
    block = min(BLOCK, max(LEAST_ROWS, n // (4 * cores)))
    parts = min(cores, -(-n // LEAST_ROWS))
    ready = _table(train, features, label, keys, model.edges, model.missing, block)
    rows, pending = None, []
    at_once = spark.conf.get(_AT_ONCE)
    try:
        for number in range(trees):
            if number % every == 0:
                path = f"{folder}/{number}"
                (ready if rows is None else _with_margins(rows, pending, len(features))).write.parquet(path)
                if rows is not None:
                    rows.unpersist()
                    _drop(spark, f"{folder}/{number - every}")
                spark.conf.set(_AT_ONCE, str(BLOCKS_AT_ONCE))  # from here on a row is a block
                table, pending = spark.read.schema(_BLOCKS).parquet(path), []
                small = input_bytes(table) < cores * TASK_BYTES
                rows = (table.repartition(parts) if small else table).persist(StorageLevel.MEMORY_AND_DISK)
            columns = sorted(draw.choice(len(features), n_columns, replace=False).tolist())
            tree = _grow(rows, model, pending, number, columns, depth, rate, row_share, positive, penalty, child_weight)
            pending.append(tree)
            model.trees.append(tree)
    finally:
        spark.conf.set(_AT_ONCE, at_once)
        if rows is not None:
            rows.unpersist()
        _drop(spark, folder)
    return model


def _with_margins(rows: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in range(len(batch)):
                _, _, bins, margin = _block(batch, i, width)
                made.append((margin + sum(t.value[t.walk(bins)] for t in trees)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), batch.column("bins"), pa.array(made, pa.binary())], ["key", "label", "bins", "margin"])

    return rows.mapInArrow(run, _BLOCKS)
