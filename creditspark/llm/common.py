"""Helpers shared by the text operators: reading, cutting lineage, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
CHUNK = 1 << 20
#: Rows of text that Spark hands to a Python worker at once; the default of 10,000 holds some 100 MB of long texts.
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write once to a new table in the shared folder and go on from there.

    It cuts the lineage, survives lost executors, is compressed, and the planner sees its true size (a checkpoint keeps
    the estimates of its plan, which joins in a loop multiply without end).
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables of one run of an operator, in a folder of its own in the shared folder.

    `keep` writes a table and goes on from there, as `stored` does; `drop` deletes tables that nothing later reads,
    and `close` all but the one named.  What stays is the operator's result.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, held in self.paths.items():
            if held is not None and any(held is t for t in tables):
                self._delete(path)
                self.paths[path] = None

    def close(self, result: DataFrame) -> DataFrame:
        """The stored result; every other table of the run is deleted."""
        out = self.keep(result)
        self.drop(*[t for t in self.paths.values() if t is not None and t is not out])
        return out

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, order: list, shelf: Shelf, name: str, start: int = 1) -> DataFrame:
    """`df`, stored, with the numbers start, start + 1, ... in `order` as column `name`.

    Rows are sorted by ranges; the driver only adds up the sizes of the ranges.
    """
    placed = shelf.keep(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts = np.cumsum([start] + [n for _, n in sizes])
    starts = df.sparkSession.createDataFrame([(int(p), int(firsts[i])) for i, (p, _) in enumerate(sizes)], "_p int, _first long")
    return placed.join(F.broadcast(starts), part == F.col("_p")).select(
        *df.columns, (F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where driver and executors share one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and the n + 1 offsets of the strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(batch.column(column))[1])
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def crc_remainder(column: str, parts: int = 3):
    """crc32 of the id written as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
