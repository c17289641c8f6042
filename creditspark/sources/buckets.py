"""Tables stored in buckets of the loan, so that joins and windows on it need no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from creditspark import schema
from creditspark.functions import cleaning

BUCKETS = 200


def write_buckets(
    df: DataFrame, table: str, path: str, key: str = schema.LOAN, buckets: int = BUCKETS,
    sort_by: Sequence[str] = (schema.MONTH,),
) -> DataFrame:
    """Write `df` with trimmed keys as a table of `buckets` buckets on `key`, one sorted file each; fails if it exists.

    Tables with the same number of buckets have equal keys in equal buckets.
    """
    order = [key, *[c for c in sort_by if c in df.columns]]
    rows = df.withColumn(key, cleaning.join_key(key)).repartition(buckets, key).sortWithinPartitions(*order)
    rows.write.mode("errorifexists").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def open_buckets(
    spark: SparkSession, table: str, path: str, key: str = schema.LOAN, buckets: int = BUCKETS,
    sort_by: Sequence[str] = (schema.MONTH,),
) -> DataFrame:
    """A stored table in a session whose catalog does not know it yet."""
    if not spark.catalog.tableExists(table):
        found = spark.read.parquet(path)
        order = ", ".join(f"`{c}`" for c in (key, *[c for c in sort_by if c in found.columns]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def is_bucketed(df: DataFrame) -> bool:
    """Whether the plan reads its tables by buckets."""
    return "Bucketed: true" in df._jdf.queryExecution().executedPlan().toString()
