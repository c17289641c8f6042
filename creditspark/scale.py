"""Size checks and the distributed forms behind them.

Three things do not scale when written the short way: a window over one hot key,
a running total without a partition key, and an exact percentile (one value map
per group).  Each helper here uses the short plan only when the input is known
to be small, and otherwise an equivalent plan in which no task holds a whole
group.  Both plans give the same rows.

Session settings:
  spark.creditspark.smallBytes   inputs up to this many bytes take the short plan
  spark.creditspark.hotRows      rows above which one key counts as hot
  spark.creditspark.chunkRows    rows of a hot key handled by one task
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SMALL_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000
CHUNK_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
CELL_BITS = 12
#: Cells of a histogram in the selection of quantiles, and its passes at most.
CELLS = 1024
PASSES = 8


def setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.creditspark.{name}", str(default)))


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables the plan reads, from the optimizer's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(
        int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())
    )


def is_small(df: DataFrame) -> bool:
    return input_bytes(df) <= setting(df, "smallBytes", SMALL_BYTES)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under the cluster's shared checkpoint folder, removed when the session ends.

    Without such a setting only a local master, where driver and tasks share one disk, has a folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._jvm.java.lang.System.getProperty("java.io.tmpdir")
    path = f"{root.rstrip('/')}/creditspark-{context.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder and drop the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the table is proven small; otherwise left to the planner.

    A small table at the end of a large plan is stored once, counted and used from there.
    """
    if is_small(df):
        return F.broadcast(df)
    stored = cut(df.limit(max_rows + 1))
    return F.broadcast(stored) if stored.count() <= max_rows else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, table: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Add the columns of a one-row-per-group table; one row in all if `on` is empty."""
    names = [c for c in table.columns if c not in on]
    if on:
        return join_on(df, bounded_broadcast(table), on, "left")
    row = table.select(F.struct(*names).alias("row")).scalar()
    return df.withColumn("_row", row).select(
        "*", *[F.col("_row")[n].alias(n) for n in names]
    ).drop("_row")


# --- windows per entity -----------------------------------------------------


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than one task should hold (pre-aggregated count)."""
    limit = setting(df, "hotRows", HOT_ROWS)
    return cut(df.groupBy(key).count().filter(F.col("count") > limit).select(key))


def row_hash(df: DataFrame) -> Column:
    """A number of the whole row: rows that differ have a fixed order whatever the layout.

    It reads every column, so it is used only for keys that have repeated rows (`repeated_keys`).
    """
    return F.xxhash64(*sorted(df.columns))


def repeated_keys(
    df: DataFrame, key: str, order: str, ties: Sequence[str] = (), parents: DataFrame | None = None,
) -> DataFrame | None:
    """Keys of which (order, ties) leave the order of some rows open, stored; None if there are none.

    A pre-aggregated count over these columns only.  `parents` is a table joined to `df` on the key; keys it
    repeats repeat the rows of `df`.
    """
    known = [c for c in ties if c in df.columns]
    found = df.groupBy(key, order, *known).count().filter("count > 1").select(key)
    if parents is not None:
        found = found.unionByName(parents.groupBy(key).count().filter("count > 1").select(key))
    return None if found.isEmpty() else cut(found.distinct())


def bounded(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if it has few rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def entity_windows(
    df: DataFrame,
    key: str,
    order: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    behind: int = 0,
    ahead: int = 0,
    ties: Sequence[str] = (),
    skew_from: DataFrame | None = None,
    distinct: bool = False,
    parents: DataFrame | None = None,
    repeated: DataFrame | None | bool = True,
) -> DataFrame:
    """Add window columns per `key`, ordered by `order`, that look at most `behind`
    rows back and `ahead` rows forward.

    `ties` settle the order of repeated (key, order) rows; ties are flag or code columns with few values.
    Keys with rows that they leave open (`repeated`; by default looked for with `repeated_keys`) take a hash of the
    whole row as well; the plan of all other rows reads only the columns that are wanted.  Hot keys and
    repeats are counted in `skew_from` (default: `df`; pass the narrow source table when `df` is
    the result of a join, and the other side of the join as `parents`).  A hot key is cut into chunks of consecutive rows, each
    with the neighbouring rows it looks at, so no task holds the whole key.  With
    `distinct`, repeated rows are dropped first, within the same exchange on the key.
    """
    def plain(part: DataFrame, fixed: bool = False) -> DataFrame:
        if distinct:
            part = part.repartition(key).distinct()
        last = [row_hash(part)] if fixed else []
        return part.withColumns(columns(Window.partitionBy(key).orderBy(order, *ties, *last)))

    def ordered(part: DataFrame) -> DataFrame:
        if repeated is None:
            return plain(part)
        keys = bounded(repeated)
        return plain(join_on(part, keys, [key], "left_anti")).unionByName(
            plain(join_on(part, keys, [key], "left_semi"), fixed=True))

    source = df if skew_from is None else skew_from
    if repeated is True:
        repeated = repeated_keys(source, key, order, ties, parents)
    if is_small(source):
        return ordered(df)
    hot = hot_keys(source, key)
    n_hot = hot.count()
    if n_hot == 0:
        return ordered(df)
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    cold_rows = join_on(df, hot, [key], "left_anti")
    hot_rows = join_on(df, hot, [key], "left_semi")
    if distinct:
        hot_rows = hot_rows.distinct()
    return ordered(cold_rows).unionByName(
        _chunked_windows(hot_rows, key, order, columns, behind, ahead, ties)
    )


def calendar_max(
    df: DataFrame, key: str, month: str, columns: dict[str, tuple[Column, int, int]],
    skew_from: DataFrame | None = None,
) -> DataFrame:
    """Add per `key` the largest value among the rows `low` to `high` months from the row: {name: (value, low, high)}.

    Months are dates or numbers that count months.  Rows of one month are equals: they see the same months, so their order
    does not matter.  A hot key is reduced to one row per month first, which no task
    needs to hold whole, and the results go back to its rows.  Rows without a month get null.
    """
    kind = dict(df.dtypes)[month]
    index = F.year(month) * 12 + F.month(month) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(month).cast("long")
    df = df.withColumns({"_month": index.cast("long")} | {f"_v{i}": v for i, (v, _, _) in enumerate(columns.values())})
    extra = ["_month", *[f"_v{i}" for i in range(len(columns))]]

    def windows(part: DataFrame) -> DataFrame:
        by_month = Window.partitionBy(key).orderBy("_month")
        return part.withColumns({
            name: F.when(F.col("_month").isNotNull(), F.max(f"_v{i}").over(by_month.rangeBetween(low, high)))
            for i, (name, (_, low, high)) in enumerate(columns.items())})

    source = df if skew_from is None else skew_from
    hot = None if is_small(source) else hot_keys(source, key)
    if hot is None or hot.isEmpty():
        return windows(df).drop(*extra)
    keys = bounded(hot)
    hot_rows = join_on(df, keys, [key], "left_semi")
    monthly = hot_rows.filter("_month is not null").groupBy(key, "_month").agg(*[F.max(c).alias(c) for c in extra[1:]])
    found = cut(windows(monthly).select(key, "_month", *columns))
    return windows(join_on(df, keys, [key], "left_anti")).drop(*extra).unionByName(
        join_on(hot_rows, bounded(found), [key, "_month"], "left").drop(*extra))


def _chunked_windows(df, key, order, columns, behind, ahead, ties):
    size = max(setting(df, "chunkRows", CHUNK_ROWS), behind, ahead)
    # Position of every row in its key = rows in earlier (order, ties) + rows in earlier cells + place in its cell.
    # The cell is the high end of the row's hash, so it spreads repeats of one (key, order) and keeps their order.
    names = df.columns
    cells = cut(df.withColumn("_hash", row_hash(df)).withColumn("_cell", F.shiftright("_hash", 64 - CELL_BITS)))
    ranked = [order, *ties]
    counts = cut(cells.groupBy(key, *ranked, "_cell").agg(F.count(F.lit(1)).alias("_n")))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_rank = counts.groupBy(key, *ranked).agg(F.sum("_n").alias("_n")).withColumn(
        "_before", earlier(Window.partitionBy(key).orderBy(*ranked))).drop("_n")
    starts = counts.withColumn("_start", earlier(Window.partitionBy(key, *ranked).orderBy("_cell"))).drop("_n")
    starts = join_on(starts, by_rank, [key, *ranked])
    place = Window.partitionBy(key, *ranked, "_cell").orderBy("_hash", *names)
    placed = join_on(
        cells.withColumn("_place", F.row_number().over(place)), starts, [key, *ranked, "_cell"]
    ).withColumn("_pos", F.col("_before") + F.col("_start") + F.col("_place") - 1)

    own = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") % size
    wanted = F.array(
        own,
        F.when(offset < ahead, own - 1),
        F.when(offset >= size - behind, own + 1),
    )
    spread_rows = placed.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_compact(wanted))
    )
    chunk = Window.partitionBy(key, "_chunk").orderBy("_pos")
    return (
        spread_rows.withColumns(columns(chunk))
        .filter(F.col("_chunk") == F.col("_own"))
        .drop("_hash", "_cell", "_before", "_start", "_place", "_pos", "_own", "_chunk")
    )


# --- running totals and quantiles -------------------------------------------


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums `cum_<s>` and totals `all_<s>` in `order`.

    `df` holds one row per (groups, order).  Large inputs are cut into value ranges;
    the range totals give each range its starting sum, so every window is local.
    """
    groups = list(groups)

    def ordered(*names):
        return [F.col(n).desc() if descending else F.col(n).asc() for n in names]

    if is_small(df):
        group = Window.partitionBy(*groups)
        upto = group.orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {f"cum_{s}": F.sum(s).over(upto) for s in sums}
            | {f"all_{s}": F.sum(s).over(group) for s in sums}
        )

    df = cut(df)
    ranges = -(-df.count() // setting(df, "chunkRows", CHUNK_ROWS))  # as many rows in each, however many there are
    ranged = cut(df.repartitionByRange(max(int(ranges), 1), *groups, order).withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy(*groups, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    group = Window.partitionBy(*groups)
    before = group.orderBy(*ordered("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumns(
        {f"_before_{s}": F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)) for s in sums}
        | {f"all_{s}": F.sum(f"_sum_{s}").over(group) for s in sums}
    ).drop(*[f"_sum_{s}" for s in sums])
    upto = (
        Window.partitionBy(*groups, "_range").orderBy(*ordered(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_on(ranged, starts, [*groups, "_range"])
        .withColumns({f"cum_{s}": F.col(f"_before_{s}") + F.sum(s).over(upto) for s in sums})
        .drop("_range", *[f"_before_{s}" for s in sums])
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    name: str = "q",
    aggs: Sequence[Column] = (),
    approx: bool = False,
    frequency: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of `value` per group as array `name`, plus `aggs`.

    With `frequency`, a row stands for that many equal values.
    """
    groups = list(groups)
    if approx:
        return df.groupBy(*groups).agg(
            *aggs, F.percentile_approx(value, list(probs), 10_000).alias(name)
        )
    if is_small(df):
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        times = F.col(frequency) if frequency else F.lit(1)
        return df.groupBy(*groups).agg(*aggs, F.percentile(value, wanted, times).alias(name))

    result = _selected(df, value, probs, groups, name, frequency)
    if not aggs:
        return result
    rest = df.groupBy(*groups).agg(*aggs)
    return attach(rest, result, groups)


def _cell(value: Column, low: Column, high: Column) -> Column:
    """The cell of [low, high] that holds a value, in the order of the values; infinities and NaN have cells of their own.

    Differences are taken of halves, so they never overflow; an interval too narrow for that is one cell.
    """
    width = high / 2 - low / 2
    share = F.when(width > 0, (value / 2 - low / 2) / F.when(width > 0, width))
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)).cast("int")
    return (F.when(F.isnan(value), F.lit(CELLS + 1)).when(value == float("inf"), F.lit(CELLS))
            .when(value == float("-inf"), F.lit(-1)).otherwise(inside))


def _selected(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str], name: str, frequency: str | None,
) -> DataFrame:
    """Exact quantiles by selection: histograms that are refined around the wanted ranks of all groups at once.

    Each pass counts the values of the open intervals in CELLS cells, pre-aggregated, and keeps the cell that holds a
    rank, narrowed to its smallest and largest value, until the two are equal.  What is shuffled is bounded by groups, ranks and
    CELLS, not by the distinct values.  As soon as the open intervals hold no more rows than one task should (`chunkRows`), or
    after PASSES passes, the rest is counted per value.
    """
    groups, chunk = list(groups), setting(df, "chunkRows", CHUNK_ROWS)
    weight = F.lit(1) if frequency is None else F.col(frequency)
    rows = df.select(*groups, F.col(value).cast("double").alias("_v"), weight.cast("long").alias("_w"))
    known = rows.filter(F.col("_v").isNotNull() & (F.col("_w") > 0))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    whole = cut(rows.groupBy(*groups).agg(
        F.sum(F.when(F.col("_v").isNotNull() & (F.col("_w") > 0), F.col("_w"))).alias("_all"), F.coalesce(F.min(finite), F.lit(0.0)).alias("_low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("_high")))
    at = [F.struct((F.lit(2 * i + j)).alias("_i"), end((F.col("_all") - 1) * F.lit(float(p))).cast("long").alias("_rank"))
          for i, p in enumerate(probs) for j, end in enumerate((F.floor, F.ceil))]
    # one row per group and rank: the interval that holds it and the rows below that interval
    targets = cut(whole.filter("_all is not null").select(
        *groups, "_low", "_high", F.lit(0).cast("long").alias("_below"), F.explode(F.array(*at)).alias("_t")
    ).select(*groups, "_low", "_high", "_below", "_t.*"))
    done, open_rows = [], None
    for step in range(PASSES):
        inside = known if step == 0 else _inside(known, targets, groups)
        if step == 0:
            inside = attach(inside, whole.select(*groups, "_low", "_high"), groups)
        cells = inside.withColumn("_cell", _cell(F.col("_v"), F.col("_low"), F.col("_high"))).groupBy(
            *groups, "_low", "_cell").agg(F.sum("_w").alias("_n"), F.count("_w").alias("_rows"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        targets = cut(_narrowed(cells, targets, groups, "_cell"))
        done.append(targets.filter("_low = _high"))
        targets = targets.filter("_low < _high")
        open_rows = targets.select(*groups, "_low", "_rows").distinct().agg(F.sum("_rows")).first()[0]
        if open_rows is None or open_rows <= chunk:
            break
    if open_rows is not None:
        counts = _inside(known, targets, groups).groupBy(*groups, "_low", "_v").agg(F.sum("_w").alias("_n"), F.count("_w").alias("_rows"))
        totals = running_totals(counts, "_v", ["_n"], [*groups, "_low"])
        found = join_on(targets.drop("_high", "_rows"), totals.drop("_rows"), [*groups, "_low"]).filter(
            (F.col("cum__n") - F.col("_n") <= F.col("_rank") - F.col("_below")) & (F.col("_rank") - F.col("_below") < F.col("cum__n")))
        done.append(found.select(*groups, F.col("_v").alias("_low"), "_i"))
    ends = reduce(DataFrame.unionByName, [d.select(*groups, "_low", "_i") for d in done])
    picked = ends.groupBy(*groups).agg(*[F.max(F.when(F.col("_i") == i, F.col("_low"))).alias(f"_e{i}") for i in range(2 * len(probs))])
    exact = []
    for i, p in enumerate(probs):
        position = (F.col("_all") - 1) * F.lit(float(p))
        low, high, part = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}"), position - F.floor(position)
        exact.append(F.when(low == high, low).otherwise((1 - part) * low + part * high))
    both = attach(whole.select(*groups, "_all"), picked, groups)
    return both.select(*groups, F.when(F.col("_e0").isNotNull(), F.array(*exact)).alias(name))


def _inside(known: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of `known` in an open interval of their group, with its ends; intervals of a group are equal or disjoint."""
    intervals = targets.groupBy(*groups).agg(F.collect_set(F.struct("_low", "_high")).alias("_open"))  # two for each quantile at most
    joined = attach(known, cut(intervals), groups)
    mine = F.filter("_open", lambda t: (t["_low"] <= F.col("_v")) & (F.col("_v") <= t["_high"]))
    return joined.withColumn("_open", F.get(mine, F.lit(0))).filter("_open is not null").select("*", "_open.*").drop("_open")


def _narrowed(cells: DataFrame, targets: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Targets with the cell that holds their rank as the new interval."""
    window = Window.partitionBy(*groups, "_low").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("_upto", F.sum("_n").over(window))  # at most CELLS + 3 rows in each window
    rank = F.col("_rank") - F.col("_below")
    # an interval has at most CELLS + 3 cells, of which each rank takes one
    return join_on(targets.drop("_rows"), counted, [*groups, "_low"]).filter((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))).select(
        *groups, F.col("_first").alias("_low"), F.col("_last").alias("_high"), (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below"),
        "_i", "_rank", "_rows")
