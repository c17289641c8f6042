"""A record of every input file: what was read, what was skipped and why."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ, UNREADABLE, WRONG_FIELDS, EMPTY = "read", "unreadable", "wrong fields", "empty"
LEDGER = "file string, bytes long, status string, rows long, wrong_rows long"


def _plain(file: str) -> str:
    """One spelling for local files."""
    return file.replace("file:///", "file:/")


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file and bytes of all files with content that the paths or patterns name; none is read."""
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _counted(spark: SparkSession, files: list[str], n_fields: int, sep: str) -> list[tuple[str, int, int]]:
    """file, rows and rows with another number of fields, from one pass over the text."""
    lines = spark.read.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).text(files)
    wrong = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit(""))) != n_fields - 1
    counts = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))
    return [(r["file"], r["n"], r["wrong"]) for r in counts.collect()]


def _unreadable(error: Exception) -> bool:
    """Whether a job failed because of a file's content, not because of the cluster."""
    text = str(error)
    return any(s in text for s in ("FAILED_READ_FILE", "Unexpected end of input stream", "not a gzip file", "ZipException", "FileNotFound"))


def _searched(spark: SparkSession, files: list[str], n_fields: int, sep: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Counts of the readable files, and the others: a group that fails is read again in halves.

    Without a bad file this is one job; each bad file costs as many more as the halvings that single it out.
    """
    if not files:
        return [], []
    try:
        return _counted(spark, files, n_fields, sep), []
    except (PySparkException, Py4JJavaError) as error:
        if not _unreadable(error):
            raise
    if len(files) == 1:
        return [], files
    parts = [_searched(spark, half, n_fields, sep) for half in (files[:len(files) // 2], files[len(files) // 2:])]
    return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]


def file_ledger(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str], sep: str = "|", most_wrong: float = 0.0,
) -> DataFrame:
    """file, bytes, status, rows and wrong_rows, one row per file.

    Status `unreadable`: the file cannot be read to its end (a cut-off archive); `wrong fields`: more than the share
    `most_wrong` of its lines have another number of fields than the layout; `empty`: no line; else `read`.  The text is
    read once; the driver holds the names and counts of files, never their lines.
    """
    sizes = {_plain(r["file"]): r["bytes"] for r in list_files(spark, path).collect()}
    sizes = {_plain(f): 0 for f in spark.read.text(path if isinstance(path, str) else list(path)).inputFiles()} | sizes
    counts, bad = _searched(spark, sorted(f for f, size in sizes.items() if size), len(fields), sep)
    known = {_plain(f): (n, wrong) for f, n, wrong in counts}
    rows = []
    for file, size in sorted(sizes.items()):
        n, wrong = known.get(file, (0, 0))
        if file in bad:
            rows.append((file, size, UNREADABLE, None, None))
        else:
            status = EMPTY if not n else WRONG_FIELDS if wrong > most_wrong * n else READ
            rows.append((file, size, status, n, wrong))
    return spark.createDataFrame(rows, LEDGER)


def readable(ledger: DataFrame) -> list[str]:
    """The files whose rows are to be read."""
    return sorted(r["file"] for r in ledger.where(F.col("status") == READ).select("file").collect())
