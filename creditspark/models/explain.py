"""Importance tables and additive explanations."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this file travel to the tasks by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def input_names(model: PipelineModel) -> list[str]:
    """Features in the order of the model's vector."""
    return [c.removeprefix("in_") for c in model.stages[1].getInputCols()]


def gain_importance(model: PipelineModel) -> DataFrame:
    """Feature and its share of the tree gain, features without a split left out."""
    trees = model.stages[2]
    values = zip(input_names(model), trees.featureImportances.toArray().tolist())
    rows = [(name, value) for name, value in values if value > 0]
    return _session().createDataFrame(rows, "variable string, gain double")


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def top_features(importance: DataFrame, value: str, n: int = 15) -> DataFrame:
    return importance.orderBy(F.col(value).desc(), "variable").limit(n)


# --- tree models ------------------------------------------------------------


def tree_leaves(model: PipelineModel, path: str) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves as (value, [(feature, low, high, share)]), read from the saved trees.

    A feature met several times on a path becomes one interval (low, high] and the
    product of its branch shares.
    """
    trees = model.stages[2]
    trees.write().overwrite().save(path)
    stored = _session().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = trees.treeWeights
    by_tree: dict[int, dict[int, object]] = {}
    for node in stored:
        by_tree.setdefault(node.treeID, {})[node.id] = node
    leaves = []
    for tree, nodes in by_tree.items():
        stack = [(0, {})]
        while stack:
            number, path_ = stack.pop()
            node = nodes[number]
            if node.leftChild < 0:
                steps = [(f, *v) for f, v in sorted(path_.items())]
                leaves.append((weights[tree] * node.prediction, steps))
                continue
            feature = node.split.featureIndex
            threshold = node.split.leftCategoriesOrThreshold[0]
            low, high, share = path_.get(feature, (-np.inf, np.inf, 1.0))
            for child, limits in (
                (node.leftChild, (low, min(high, threshold))),
                (node.rightChild, (max(low, threshold), high)),
            ):
                part = nodes[child].impurityStats[0] / node.impurityStats[0]
                stack.append((child, path_ | {feature: (*limits, share * part)}))
    return leaves


def tree_contributions(x: np.ndarray, leaves) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of a sum of trees (Lundberg et al. 2018).

    A leaf is a product game: a known feature counts 1 inside its interval and 0
    outside, an unknown one counts its branch share.  Its values follow from the
    coefficients of a product of linear terms, for all rows at once.
    """
    out = np.zeros(x.shape)
    base = 0.0
    for value, steps in leaves:
        m = len(steps)
        shares = [s[3] for s in steps]
        base += value * float(np.prod(shares))
        inside = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in steps]
        for j in range(m):
            coefficients = [np.ones(len(x))]
            for k in range(m):
                if k == j:
                    continue
                wider = [shares[k] * c for c in coefficients] + [np.zeros(len(x))]
                for s, c in enumerate(coefficients):
                    wider[s + 1] = wider[s + 1] + inside[k] * c
                coefficients = wider
            total = sum(
                c * (factorial(s) * factorial(m - 1 - s) / factorial(m))
                for s, c in enumerate(coefficients)
            )
            out[:, steps[j][0]] += value * (inside[j] - shares[j]) * total
    return out, base


def shap_values(model: PipelineModel, df: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Log-odds contributions of a boosted-tree model: `shap` array and `base` value.

    Spark's boosted probability is 1 / (1 + exp(-2 margin)), so both are doubled.
    """
    leaves = _session().sparkContext.broadcast(tree_leaves(model, path))
    names = input_names(model)
    ready = model.stages[1].transform(model.stages[0].transform(df))
    rows = ready.select(*keep, vector_to_array("features").alias("_x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.vstack(batch["_x"]) if len(batch) else np.zeros((0, len(names)))
            values, base = tree_contributions(x, leaves.value)
            yield batch.drop(columns="_x").assign(shap=list(2.0 * values), base=2.0 * base)

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_x").dtypes)
    return rows.mapInPandas(explain, (kept + ", " if kept else "") + "shap array<double>, base double")


def contribution_rows(explained: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per kept key and feature."""
    labelled = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("variable"), F.col("shap").alias("contribution"))
    return explained.select(*keep, F.explode(labelled).alias("_x")).select(*keep, "_x.*")


def shap_importance(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature."""
    wide = explained.agg(*[F.avg(F.abs(F.col("shap")[i])).alias(n) for i, n in enumerate(names)])
    return wide.unpivot([], list(names), "variable", "mean_abs_shap")


# --- logistic model ---------------------------------------------------------


def linear_contributions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Exact contributions coefficient x (value - mean) of the scaled logistic model.

    Inputs are centred on the training mean, so the intercept is the base value.
    """
    names, weights = input_names(model), model.stages[2].coefficients.toArray().tolist()
    ready = model.stages[0].transform(df)
    return ready.select(
        *df.columns, F.array(*[F.col(f"in_{c}") * F.lit(w) for c, w in zip(names, weights)]).alias("shap"),
        F.lit(model.stages[2].intercept).alias("base"),
    )


# --- single loans -----------------------------------------------------------


def extreme_loans(scored: DataFrame, keys: Sequence[str], p: str = "pd") -> DataFrame:
    """Keys and score of the highest and the lowest probability; ties by key."""
    row = F.struct(F.col(p), *keys)
    ends = scored.filter(F.col(p).isNotNull()).agg(F.max(row).alias("highest"), F.min(row).alias("lowest"))
    pair = F.explode(F.array(*[
        F.struct(F.lit(n).alias("which"), F.col(n).alias("r")) for n in ("highest", "lowest")
    ]))
    return ends.select(pair.alias("_x")).select("_x.which", "_x.r.*")
