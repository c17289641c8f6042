"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on its host if it stands on more than `ratio` of the host's pages and on more than one
page; lines are compared as they are, a line counts once per page.  Boilerplate lines go from all pages of that
host; a page of nothing else is left with its blank lines or empty.

Defined cases: a null text stays null; an empty text stays empty; blank lines stay and never count;
a null host is a host of its own; a line at exactly the ratio stays; repeated rows are pages of their own; columns beside
text and host pass unchanged, a column n_chars is set to the new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.common import stored, unused

RATIO = 0.1
#: A share of one page says nothing.
LEAST = 2
#: Boilerplate lines up to which the table is broadcast: 24 bytes each.
BROADCAST_LINES = 200_000


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """host, line (64-bit name), pages and share of each boilerplate line.

    Counts combine in each task before the shuffle, so no group meets in one task.  At most
    (lines per page / ratio) lines of a host can pass the ratio, whatever its size.
    """
    page = docs.select(F.col(host).alias("host"), F.array_distinct(
        F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))).alias("lines"))
    # one row per page, null in place of a line, counts the pages of the host
    counted = page.select("host", F.explode(F.concat(
        F.array(F.lit(None).cast("long")), F.coalesce("lines", F.array().cast("array<long>")))).alias("line"))
    counted = counted.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counted = stored(counted.where(f"line is null or pages >= {LEAST}"))
    total = counted.where("line is null").select(F.col("host").alias("of"), F.col("pages").alias("all_pages"))
    return counted.where("line is not null").join(total, F.col("host").eqNullSafe(F.col("of"))).select(
        "host", "line", "pages", (F.col("pages") / F.col("all_pages")).alias("share")).where(F.col("share") > ratio)


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """The rows and columns of `docs` with boilerplate lines taken out of `text`."""
    found = stored(boilerplate(docs, host, ratio))
    of, bad, slim = (unused(docs, c) for c in ("_host", "_lines", "_slim"))
    sets = found.groupBy(F.col("host").alias(of)).agg(F.collect_list("line").alias(bad))
    if found.count() <= BROADCAST_LINES:
        sets = F.broadcast(sets)
    joined = docs.join(sets, F.col(host).eqNullSafe(F.col(of)), "left")
    kept = F.array_join(F.filter(
        F.split("text", "\n", -1), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, F.xxhash64(x))), "\n")
    # a column of its own, so that the lines of a text are cut once
    joined = joined.withColumn(slim, F.when(F.col(bad).isNull(), F.col("text")).otherwise(kept))
    text = F.col(slim)
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.withColumns(columns).select(*docs.columns)
