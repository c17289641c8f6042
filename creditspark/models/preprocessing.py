"""Values learned from training rows, and the columns made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.summaries import long_form
from creditspark.scale import BROADCAST_ROWS, SMALL_BYTES, cut, is_small, quantiles, running_totals

#: Levels of a column that are kept as a list; more make a table.
MAX_LEVELS = 10_000
#: Levels that are compared one by one in an expression; more are joined.
LISTED = 100
#: Share of the rows from which a level counts as heavy; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str] | DataFrame]:
    """Sorted distinct values of each code column, from one aggregate.

    A column of more than MAX_LEVELS values gets a table (level, code) instead of a list.
    """
    if not columns:
        return {}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    found = cut(text.unpivot([], list(columns), "variable", "level").filter(F.col("level").isNotNull()).groupBy(
        "variable", "level").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["variable"]: r["count"] for r in found.groupBy("variable").count().collect()}
    few = [c for c in columns if sizes.get(c, 0) <= MAX_LEVELS]
    listed = found.filter(F.col("variable").isin(few)).collect()  # at most MAX_LEVELS for each column
    levels: dict[str, list[str] | DataFrame] = {c: sorted(r["level"] for r in listed if r["variable"] == c) for c in few}
    for c in columns:
        if c not in levels:
            one = found.filter(F.col("variable") == c).select("level", "n", F.lit(1).alias("_one"))
            levels[c] = cut(running_totals(one, "level", ["_one"]).select(
                "level", "n", (F.col("cum__one") - 1).cast("int").alias("code")))
    return levels


def level_code(column: str, levels: Sequence[str]) -> Column:
    """0-based position among the sorted levels; -1 for null or an unknown level."""
    known = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<string>")
    position = F.array_position(known, F.col(column).cast("string"))
    return (F.coalesce(F.nullif(position, F.lit(0)), F.lit(0)) - 1).cast("int")


def encode_levels(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str] | DataFrame] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Replace code columns by level numbers: by an expression up to LISTED levels, by a join beyond."""
    if levels is None:
        levels = fit_levels(df if fit_on is None else fit_on, columns)
    names = df.columns
    listed = {c: level_code(c, levels[c]) for c in columns if not isinstance(levels[c], DataFrame) and len(levels[c]) <= LISTED}
    out = df.withColumns(listed)
    for c in columns:
        if c not in listed:
            out = _join_codes(out, c, levels[c])
    return out.select(*names)


def _join_codes(df: DataFrame, column: str, levels: Sequence[str] | DataFrame) -> DataFrame:
    """The column replaced by the codes of a table (level, n, code) or of a list.

    A dictionary of counted rows and bytes is broadcast, so the rows are not shuffled.  Of a larger one only the heavy levels are,
    with the rows that hold them or nothing; all other rows are joined by the level, of which none is heavy any more.
    """
    if isinstance(levels, DataFrame):
        size = levels.agg(F.count("level").alias("n"), F.sum(F.octet_length("level")).alias("bytes"), F.sum("n").alias("rows")).first()
        whole = size.n <= BROADCAST_ROWS and size.bytes <= SMALL_BYTES
        table = levels.select(F.col("level").alias("_level"), F.col("code").alias("_code"), "n")
    else:
        whole = True  # a list has at most MAX_LEVELS
        table = df.sparkSession.createDataFrame([(v, i, 1) for i, v in enumerate(levels)], "_level string, _code int, n long")
    text = F.col(column).cast("string")

    def joined(rows: DataFrame, codes: DataFrame) -> DataFrame:
        return rows.join(codes.drop("n"), text == F.col("_level"), "left")

    if whole:
        out = joined(df, F.broadcast(table))
    else:
        heavy = F.broadcast(cut(table.filter(F.col("n") > HEAVY_SHARE * size.rows)))
        common = df.join(heavy.select("_level"), text == F.col("_level"), "left_anti").filter(text.isNotNull())
        often = df.join(heavy.select("_level"), text == F.col("_level"), "left_semi").unionByName(df.filter(text.isNull()))
        out = joined(often, heavy).unionByName(joined(common, table))
    return out.withColumn(column, F.coalesce("_code", F.lit(-1))).drop("_level", "_code")


def fit_medians(df: DataFrame, columns: Sequence[str], approx: bool = False) -> dict[str, float | None]:
    """Median of the known values of each column."""
    if approx or is_small(df):
        def median(c: str) -> Column:
            value = F.col(c).cast("double")
            return F.percentile_approx(value, 0.5, 10_000) if approx else F.percentile(value, 0.5)

        row = df.agg(*[median(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    found = quantiles(long_form(df, columns), "value", [0.5], ["variable"]).collect()
    medians = {r.variable: r.q[0] if r.q else None for r in found}
    return {c: medians.get(c) for c in columns}


def fill(column: str, value: float) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(float(value)))


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Fill nulls; a column without a known training value stays as it is."""
    return df.withColumns({c: fill(c, v) for c, v in values.items() if v is not None})


def fit_scaler(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; 1 where the column is constant."""
    row = df.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in columns.items()],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in columns.items()],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]], prefix: str = "z_") -> DataFrame:
    return df.withColumns({
        f"{prefix}{c}": (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()
    })


def class_weights(df: DataFrame, label: str = "label") -> dict[str, float]:
    """Row count, balanced weights n / (2 n_class) and the negatives per positive."""
    row = df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).first()
    pos = row.pos or 0
    neg = row.n - pos
    if not pos or not neg:
        raise ValueError("training rows hold a single class")
    return {
        "n": row.n, "positive": row.n / (2 * pos), "negative": row.n / (2 * neg), "ratio": neg / pos,
    }
