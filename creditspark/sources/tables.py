"""Parquet and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditspark import schema
from creditspark.functions.cleaning import normalize_columns, select_present


def read_table(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """Parquet table with canonical names; only the wanted columns that exist, if given."""
    df = normalize_columns(spark.read.parquet(path))
    return select_present(df, columns) if columns else df


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (schema.VINTAGE,),
    sort_by: Sequence[str] = (), compact_numbers: bool = False, gather: bool = True,
) -> None:
    """Write to a new path.  Fails if it exists, so an input is never overwritten.

    Rows of one partition value are brought together before the write, in pieces of the session's
    advisory size, so that a large value is spread over many tasks and a small one makes one file;
    `sort_by` sorts inside each file, which gives tight row-group ranges for loan look-ups.
    Without `gather`, rows are written where they are, without an exchange: for partitions of a few values only, since
    every task writes one file for each value it holds.
    """
    if compact_numbers:
        df = df.withColumns({
            c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"
        })
    present = [c for c in partition_by if c in df.columns]
    if present and gather:
        df = df.hint("rebalance", *present)
    if sort_by:
        df = df.sortWithinPartitions(*present, *sort_by)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*present) if present else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table with a header line."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv_table(spark: SparkSession, path: str, columns: str | StructType) -> DataFrame:
    """Result table with a declared schema."""
    return spark.read.schema(columns).option("header", True).csv(path)
