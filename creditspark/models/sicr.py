"""Significant increase in credit risk against the probability at origination."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.models.training import fit_calibrated
from creditspark.operators.summaries import describe_columns, rows


def fit_origination_model(data: DataFrame, **options) -> PipelineModel:
    """Calibrated logistic model on the origination features only."""
    features = [c for c in schema.ORIGINATION_FEATURES if c in data.columns]
    train, validation = (data.filter(F.col("split") == s) for s in ("train", "validation"))
    return fit_calibrated(train, validation, features, "logistic", **options)


def sicr_flag(
    current: str = "pd_current", origination: str = "pd_origination", dpd: str = "dpd_numerico",
    ratio: float = schema.SICR_RATIO, difference: float = schema.SICR_DIFFERENCE,
) -> Column:
    """1 for a large relative or absolute increase or any delinquency; unknown is 0."""
    tests = (
        F.try_divide(F.col(current), F.col(origination)) > ratio,
        (F.col(current) - F.col(origination)) > difference,
        F.col(dpd) >= 1,
    )
    a, b, c = (F.coalesce(t, F.lit(False)) for t in tests)
    return (a | b | c).cast("int")


def sicr_stage(flag: str = "sicr_pd_flag", stage: str = "ifrs9_stage") -> Column:
    return F.when(F.col(stage) == 3, 3).when(F.col(flag) == 1, 2).otherwise(1)


def assess(scored: DataFrame) -> DataFrame:
    """Rows with flag and stage; `scored` has both probabilities."""
    return scored.withColumn("sicr_pd_flag", sicr_flag()).withColumn("ifrs9_stage_sicr", sicr_stage())


def stage_reclassification(assessed: DataFrame) -> DataFrame:
    """Rows per (delinquency stage, SICR stage)."""
    return assessed.groupBy("ifrs9_stage", "ifrs9_stage_sicr").agg(rows().alias("n"))


def pd_summary(scored: DataFrame, approx: bool = False) -> DataFrame:
    return describe_columns(
        scored, ["pd_origination", "pd_current"], (0.25, 0.5, 0.75), approx=approx
    )
