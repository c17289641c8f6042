"""Stage migration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.operators.summaries import rows, with_share

STAGES = [1, 2, 3]


def _weight(moved: DataFrame) -> Column:
    """A counted table stands for `n` rows per row."""
    return F.col("n") if "n" in moved.columns else F.lit(1)


def transition_counts(
    moved: DataFrame, later: str, year: Column, stage: str = "ifrs9_stage",
) -> DataFrame:
    """Rows per stage, later stage, vintage and year: all tables below follow from it."""
    return moved.groupBy(stage, later, schema.VINTAGE, year.alias("year")).agg(rows().alias("n"))


def stage_matrix(moved: DataFrame, later: str, scale: float = 1.0, stage: str = "ifrs9_stage") -> DataFrame:
    """(stage, later stage, n, share of the row's stage)."""
    counts = moved.groupBy(stage, later).agg(F.sum(_weight(moved)).alias("n"))
    return with_share(counts, "n", "prob", [stage], scale)


def pivot_matrix(
    long: DataFrame, row: str, column: str, value: str, columns: Sequence[int] = tuple(STAGES),
    prefix: str = "to_",
) -> DataFrame:
    """Long form -> one row per `row`; missing cells are 0."""
    wide = long.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    return wide.na.fill(0, [str(c) for c in columns]).withColumnsRenamed(
        {str(c): f"{prefix}{c}" for c in columns}
    )


def key_rates(matrix: DataFrame, later: str, stage: str = "ifrs9_stage") -> DataFrame:
    """Direct move to default (1 to 3) and cure (2 to 1)."""
    def rate(a: int, b: int) -> Column:
        return F.max(F.when((F.col(stage) == a) & (F.col(later) == b), F.col("prob")))

    return matrix.agg(rate(1, 3).alias("stage_1_to_3"), rate(2, 1).alias("cure_rate"))


def cure_rate_yearly(moved: DataFrame, later: str, year: Column, stage: str = "ifrs9_stage") -> DataFrame:
    """Share of stage-2 rows found in stage 1 later, per year."""
    n = _weight(moved)
    cured = F.sum(F.when(F.col(later) == 1, n).otherwise(0))
    return moved.filter(F.col(stage) == 2).groupBy(year.alias("year")).agg(
        (cured / F.sum(n)).alias("cure_rate"), F.sum(n).alias("n")
    )


def stage_psi(
    moved: DataFrame, reference: Sequence[int] = tuple(schema.TRAIN_VINTAGES),
    new: Sequence[int] = tuple(schema.TEST_VINTAGES), stage: str = "ifrs9_stage",
) -> DataFrame:
    """Stability index of the stage mix over the stages both sides have."""
    def total(vintages: Sequence[int]) -> Column:
        return F.sum(F.when(F.col(schema.VINTAGE).isin(list(vintages)), _weight(moved)).otherwise(0))

    counts = moved.groupBy(stage).agg(total(reference).alias("ref"), total(new).alias("new"))
    shares = with_share(with_share(counts, "ref", "p"), "new", "q")
    both = shares.filter((F.col("ref") > 0) & (F.col("new") > 0))
    p, q = F.greatest("p", F.lit(1e-6)), F.greatest("q", F.lit(1e-6))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"), rows().alias("n_stages"))
