"""Pipe-delimited loan files without a header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions import cleaning
from creditspark.sources.ledger import file_ledger, readable


def read_pipe(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str],
    null_tokens: Sequence[str] = (), skip_unreadable: bool = False,
) -> DataFrame:
    """All columns as text; only blanks are null unless more `null_tokens` are given."""
    reader = spark.read.schema(schema.text_schema(list(fields))).options(
        sep="|", quote="", nullValue="", header=False,
        ignoreMissingFiles=skip_unreadable, ignoreCorruptFiles=skip_unreadable,
    )
    df = reader.csv(path if isinstance(path, str) else list(path))
    return cleaning.clear_tokens(df, null_tokens) if null_tokens else df


def _year_from_folder(df: DataFrame) -> DataFrame:
    found = F.regexp_extract(F.col("_metadata.file_path"), r"sample_(\d{4})/", 1)
    return df.select("*", F.nullif(found, F.lit("")).cast("int").alias(schema.VINTAGE))


def _chosen(
    spark: SparkSession, pattern: str, fields: Sequence[str], skip_unreadable: bool, ledger: DataFrame | None,
) -> DataFrame:
    """The files of a pattern or, with a ledger, those that it lists as read."""
    if ledger is None:
        return read_pipe(spark, pattern, fields, skip_unreadable=skip_unreadable)
    files = readable(ledger)
    if not files:
        raise ValueError("the ledger lists no file that can be read")
    return read_pipe(spark, files, fields)


def origination_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The record of all `sample_YYYY` origination files (see `file_ledger`)."""
    return file_ledger(spark, f"{root}/sample_*/sample_orig_*.txt*", schema.ORIGINATION_FIELDS)


def performance_ledger(spark: SparkSession, root: str) -> DataFrame:
    return file_ledger(spark, f"{root}/sample_*/sample_svcg_*.txt*", schema.PERFORMANCE_FIELDS)


def read_origination(
    spark: SparkSession, root: str, skip_unreadable: bool = False, ledger: DataFrame | None = None,
) -> DataFrame:
    """All `sample_YYYY` origination files: codes cleared, numbers cast, year from the folder.

    With a ledger (`origination_ledger`) only the files that it lists as read, each read whole or not at all.
    """
    raw = _chosen(spark, f"{root}/sample_*/sample_orig_*.txt", schema.ORIGINATION_FIELDS, skip_unreadable, ledger)
    df = cleaning.clear_codes(_year_from_folder(raw), schema.ORIGINATION_CODES)
    return cleaning.cast_numeric(df, schema.ORIGINATION_NUMERIC)


def read_performance(
    spark: SparkSession, root: str, skip_unreadable: bool = False, ledger: DataFrame | None = None,
) -> DataFrame:
    """All `sample_YYYY` performance files, cleaned in the same way."""
    raw = _chosen(spark, f"{root}/sample_*/sample_svcg_*.txt", schema.PERFORMANCE_FIELDS, skip_unreadable, ledger)
    df = cleaning.clear_codes(_year_from_folder(raw), schema.PERFORMANCE_CODES)
    return cleaning.cast_numeric(df, schema.PERFORMANCE_NUMERIC)


def read_quarterly(spark: SparkSession, root: str, skip_unreadable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quarterly `historical_data_[time_]YYYYQn.txt` files as (origination, performance).

    Files lie in `root` or one folder below it.  Numeric fields are cast, text and codes
    are kept; `orign_qtr` comes from the file name.
    """
    def load(glob: str, fields: list[str], numeric: list[str]) -> DataFrame:
        raw = read_pipe(spark, f"{root}/{glob}", fields, skip_unreadable=skip_unreadable)
        quarter = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}Q\d)", 1)
        df = raw.select("*", F.nullif(quarter, F.lit("")).alias("orign_qtr"))
        return cleaning.cast_numeric(df, numeric)

    origination = load("{historical_data_[0-9]*.txt,*/historical_data_[0-9]*.txt}",
                       schema.ORIGINATION_FIELDS, schema.ORIGINATION_NUMERIC)
    performance = load("{historical_data_time_*.txt,*/historical_data_time_*.txt}",
                       schema.PERFORMANCE_FIELDS, schema.PERFORMANCE_NUMERIC)
    return origination, performance
