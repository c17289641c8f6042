"""Distinct counts and quantiles from sketches that are stored per group and merged later.

A table of sketches has one row per group, of a bounded size however many rows the group has.  A new vintage adds
its own rows of sketches; totals over vintages come from merging them, without reading the panel again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.scale import attach

#: Buckets of a distinct-count sketch (base 2 logarithm); its relative standard error is about 0.8 / sqrt(buckets).
LOG_BUCKETS = 12
DISTINCT_ERROR = 0.8 / 2 ** (LOG_BUCKETS / 2)
#: Size of a quantile sketch; the normalized rank of a quantile is off by at most RANK_ERROR with 99 % confidence.
QUANTILE_SIZE = 200
RANK_ERROR = 0.0165


def sketch_table(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """`by`, n_rows and one sketch per column: `distinct_<c>` and `quantile_<c>`, partial sketches before the shuffle.

    Nulls are in no sketch; a group without a known value has an empty sketch or null.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), LOG_BUCKETS).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), QUANTILE_SIZE).alias(f"quantile_{c}") for c in quantiles])


def _columns(table: DataFrame, prefix: str) -> list[str]:
    return [c for c in table.columns if c.startswith(prefix)]


def merge_sketches(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups, from stored ones."""
    return table.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.hll_union_agg(c).alias(c) for c in _columns(table, "distinct_")],
        *[F.kll_merge_agg_double(c, QUANTILE_SIZE).alias(c) for c in _columns(table, "quantile_")])


def estimates(table: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """`n_<c>` for each distinct-count sketch and the array `q_<c>` of quantiles (null without a known value)."""
    def at(sketch: str) -> Column:
        known = F.kll_sketch_get_n_double(sketch) > 0
        return F.when(known, F.array(*[F.kll_sketch_get_quantile_double(F.when(known, F.col(sketch)), F.lit(float(p))) for p in probs]))

    return table.select(
        *[c for c in table.columns if not c.startswith(("distinct_", "quantile_"))],
        *[F.hll_sketch_estimate(c).alias("n_" + c.removeprefix("distinct_")) for c in _columns(table, "distinct_")],
        *[at(c).alias("q_" + c.removeprefix("quantile_")) for c in _columns(table, "quantile_")])


def sketch_audit(df: DataFrame, by: Sequence[str], distinct: str, quantile: str, prob: float = 0.5) -> DataFrame:
    """Exact counts per group and whether the sketches' estimates keep their bounds (five deviations; the rank error)."""
    guess = estimates(sketch_table(df, by, [distinct], [quantile]), [prob]).select(
        *by, F.col(f"n_{distinct}").alias("_n"), F.get(f"q_{quantile}", F.lit(0)).alias("_q"))
    value = F.col(quantile).cast("double")
    found = attach(df, guess, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(distinct)).alias("n_distinct"), F.max("_n").alias("_n"),
        F.count(value).alias("_known"), F.count_if(value < F.col("_q")).alias("_below"), F.count_if(value <= F.col("_q")).alias("_upto"))
    off = F.abs(F.col("_n") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), 5 * DISTINCT_ERROR * F.col("n_distinct"))
    # a rank between two rows belongs to either of them
    least, most = (F.col("_known") * (prob + e) for e in (-RANK_ERROR, RANK_ERROR))
    ranked = (F.col("_below") <= F.ceil(most)) & (F.col("_upto") >= F.floor(least))
    return found.select(*by, "n_rows", "n_distinct", off.alias("distinct_within"), ranked.alias("quantile_within"))
