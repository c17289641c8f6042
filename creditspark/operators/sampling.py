"""Exact-size samples that do not depend on row order or partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.scale import attach

PREFIX = 4


def sample_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _lowest(df: DataFrame, keys: Sequence[str], seed: int, strata: Sequence[str], quota: Column) -> DataFrame:
    """The `quota` rows with the lowest key hash in each stratum.

    Rows are counted per hash prefix, which gives the prefix where the quota is
    reached.  Rows beyond it are dropped in the scan; the rest is ranked per prefix,
    so no task sorts a stratum.
    """
    hashed = df.withColumn("_h", sample_hash(keys, seed)).withColumn("_b", F.substring("_h", 1, PREFIX))
    counts = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    stratum = Window.partitionBy(*(strata or [F.lit(0)]))
    upto = stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    # At most 16^PREFIX rows per stratum.
    limits = counts.withColumns({
        "_cum": F.sum("_n").over(upto), "_size": F.sum("_n").over(stratum),
        "_total": F.sum("_n").over(Window.partitionBy(F.lit(0))),
    }).withColumn("_quota", quota)
    crossing = limits.filter(F.col("_cum") > F.col("_quota")).groupBy(*strata).agg(
        F.min(F.struct("_b", (F.col("_quota") - F.col("_cum") + F.col("_n")).alias("left"))).alias("_at")
    )
    inside = F.col("_at").isNull() | (F.col("_b") <= F.col("_at._b"))
    near = attach(hashed, crossing, strata).filter(inside)
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", *keys))
    chosen = near.withColumn("_rank", rank).filter(
        F.col("_at").isNull() | (F.col("_b") < F.col("_at._b")) | (F.col("_rank") <= F.col("_at.left"))
    )
    return chosen.drop("_h", "_b", "_at", "_rank")


def random_subsample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most `n` rows without replacement."""
    return _lowest(df, keys, seed, (), F.lit(n))


def stratified_sample(
    df: DataFrame, n: int, keys: Sequence[str], strata: Sequence[str], seed: int = 42,
) -> DataFrame:
    """`int(n * size / total)` rows of each stratum, all of it if that is fewer;
    the whole table if it has at most `n` rows."""
    part = F.floor(F.lit(n) * F.col("_size") / F.col("_total"))
    quota = F.when(F.col("_total") <= n, F.col("_size")).otherwise(F.least("_size", part))
    return _lowest(df, keys, seed, strata, quota)
