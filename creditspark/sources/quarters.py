"""A table that grows by deliveries: appending one twice changes nothing, a late one replaces or adds its own rows only.

The rows of a delivery lie in partitions (value of `by`, delivery), so writing a delivery replaces its own partitions and
leaves all others as they are.  A manifest beside them says which partitions count: one small file per
append, written last.  Readers see a delivery only once its manifest entry exists, so a run that is cut off halfway leaves
nothing half visible, and partitions that a new version of a delivery no longer has are no longer read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditspark.scale import bounded

DELIVERY, VERSION = "delivery", "delivery_version"
MANIFEST = "delivery string, version long, value string, rows long, digest long"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The current entries: delivery, version, value of the partition column, rows and digest; the newest version of a delivery counts."""
    folder = f"{path}/_manifest"
    if not _exists(spark, folder):
        return spark.createDataFrame([], MANIFEST)
    entries = spark.read.schema(MANIFEST).json(folder)
    newest = entries.withColumn("_newest", F.max("version").over(Window.partitionBy("delivery")))
    return newest.filter(F.col("version") == F.col("_newest")).drop("_newest")


def append_delivery(df: DataFrame, path: str, delivery: str, by: str = "orign_qtr") -> bool:
    """Add the rows of a delivery, or put them in the place of its earlier version; False if they are already there.

    Rows are compared by count and digest per value of `by`, which does not depend on their order.  Only
    partitions of this delivery are written.
    """
    spark = df.sparkSession
    value = F.coalesce(F.col(by).cast("string"), F.lit(""))
    per_row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    found = df.groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(per_row.cast("decimal(38,0)")).alias("s"), F.bit_xor(per_row).alias("x"))
    found = {r["value"]: (r["rows"], hash_of(r["s"], r["x"])) for r in found.collect()}  # one row per value of `by`
    known = {r["value"]: (r["rows"], r["digest"], r["version"]) for r in manifest(spark, path).filter(F.col("delivery") == delivery).collect()}
    if found == {k: v[:2] for k, v in known.items()}:
        return False
    version = max((v[2] for v in known.values()), default=0) + 1
    marked = df.withColumns({f"_{by}": value, DELIVERY: F.lit(delivery), VERSION: F.lit(version)})
    marked.hint("rebalance", f"_{by}").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy(f"_{by}", DELIVERY, VERSION).parquet(f"{path}/rows")
    entry = [(delivery, version, k, n, digest) for k, (n, digest) in sorted(found.items())] or [(delivery, version, None, 0, 0)]
    spark.createDataFrame(entry, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return True


def hash_of(total, mixed: int) -> int:
    """Sum and exclusive or of the row hashes in one 63-bit number."""
    return (int(total or 0) * 0x9E3779B97F4A7C15 + int(mixed or 0)) % (1 << 63)


def read_deliveries(spark: SparkSession, path: str, by: str = "orign_qtr") -> DataFrame:
    """All rows that count, with the column `delivery`; the manifest is joined with the partitions, so others are not read."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    current = bounded(manifest(spark, path).filter("rows > 0").select(
        F.col("delivery").alias("_d"), F.col("version").alias("_v"), F.col("value").alias("_k")))
    return rows.join(current, (F.col(DELIVERY) == F.col("_d")) & (F.col(VERSION) == F.col("_v")) & (
        F.col(f"_{by}").eqNullSafe(F.col("_k")) | (F.col(f"_{by}").isNull() & (F.col("_k") == ""))), "left_semi").drop(f"_{by}", VERSION)
