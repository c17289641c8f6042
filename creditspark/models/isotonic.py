"""Isotonic calibration whose blocks stay in tables.

The fit is the greatest convex minorant of the points (rows so far, events so far) in score order; the slope of an edge is the
probability of the scores it spans.  The points are cut into chunks of consecutive scores.  Each chunk keeps its own
minorant; then the edges that cross chunks are searched for together: an open edge is lowered to the point furthest
below it, which splits it, until no point is below.  An edge whose ends lie in one chunk is left to that chunk.  There are
fewer open edges than chunks at any time, so the driver holds a few numbers per chunk and no list of blocks.

Defined cases: rows without score or outcome are left out of the fit, a missing score gets a missing probability, equal scores are pooled first,
an empty table gives no blocks, and scores outside the fitted range get the nearest probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.scale import CHUNK_ROWS, attach, bounded_broadcast, cut, running_totals, setting

#: Points closer to an edge than this share of the compared sums lie on it.
ROUNDING = 2.0 ** -50
_HULL = "_chunk long, _x double, _y double, _p double, _next double"


def _minorant(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of the points on the greatest convex minorant, ends included."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            rise, chord = (y[b] - y[a]) * (x[i] - x[a]), (y[i] - y[a]) * (x[b] - x[a])
            if rise - chord < -ROUNDING * (abs(rise) + abs(chord)):
                break
            kept.pop()
        kept.append(i)
    return kept


def _chunk_minorant(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("_x", ignore_index=True)
    part["_next"] = part["_p"].shift(-1)
    kept = _minorant(part["_x"].to_numpy(), part["_y"].to_numpy())
    return part.loc[kept, ["_chunk", "_x", "_y", "_p", "_next"]]


def _points(df: DataFrame, y: str, p: str) -> DataFrame:
    """One point per distinct score with the chunk it belongs to, and the origin in the first chunk."""
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    tallies = known.groupBy(F.col(p).cast("double").alias("_p")).agg(
        F.count(F.lit(1)).cast("double").alias("_w"), F.sum(F.col(y).cast("double")).alias("_s"), F.lit(1).cast("long").alias("_one"))
    totals = running_totals(tallies, "_p", ["_w", "_s", "_one"])
    size = setting(df, "chunkRows", CHUNK_ROWS)
    points = totals.select(
        F.floor((F.col("cum__one") - 1) / size).cast("long").alias("_chunk"),
        F.col("cum__w").alias("_x"), F.col("cum__s").alias("_y"), "_p")
    origin = df.sparkSession.createDataFrame([(0, 0.0, 0.0, None)], "_chunk long, _x double, _y double, _p double")
    return points.unionByName(origin)


def isotonic_blocks(df: DataFrame, y: str, p: str) -> DataFrame:
    """The blocks of the isotonic fit of `y` on `p`: low, high (first and last score), pd and n, the rows."""
    spark = df.sparkSession
    hull = cut(_points(df, y, p).groupBy("_chunk").applyInPandas(_chunk_minorant, _HULL))
    point = F.struct("_chunk", "_x", "_y", "_next")
    ends = hull.groupBy("_chunk").agg(
        F.min("_p").alias("first"), F.min_by(point, "_x").alias("a"), F.max_by(point, "_x").alias("b")).collect()  # one row per chunk
    start, stop = min((tuple(r.a) for r in ends)), max((tuple(r.b) for r in ends))
    found, open_edges = {start, stop}, [(start, stop)]
    while open_edges := [(a, b) for a, b in open_edges if a[0] < b[0]]:
        rows = [(i, c, a[1], a[2], b[1], (b[2] - a[2]) / (b[1] - a[1]))
                for i, (a, b) in enumerate(open_edges) for c in range(a[0], b[0] + 1)]  # two for each chunk at most
        edges = spark.createDataFrame(rows, "_edge int, _chunk long, _x0 double, _y0 double, _x1 double, _slope double")
        rise, chord = F.col("_y") - F.col("_y0"), F.col("_slope") * (F.col("_x") - F.col("_x0"))
        below = hull.join(bounded_broadcast(edges), "_chunk").filter(
            (F.col("_x") > F.col("_x0")) & (F.col("_x") < F.col("_x1"))
            & (rise - chord < -ROUNDING * (F.abs(rise) + F.abs(chord))))
        lowest = below.groupBy("_edge").agg(F.min_by(point, F.struct(rise - chord, "_x")).alias("v")).collect()
        split = [(open_edges[r["_edge"]], tuple(r.v)) for r in lowest]
        found.update(v for _, v in split)
        open_edges = [part for (a, b), v in split for part in ((a, v), (v, b))]
    return _blocks(hull, sorted(found, key=lambda v: v[1]), {r["_chunk"]: r.first for r in ends})


def _blocks(hull: DataFrame, found: list[tuple], firsts: dict[int, float]) -> DataFrame:
    """The edges of the minorant, which runs through a chunk from the first to the last vertex that was found in it."""
    after = lambda v: firsts.get(v[0] + 1) if v[3] is None else v[3]  # noqa: E731  the score after a vertex
    spans: dict[int, list] = {}
    for before, v in zip([(None,) * 4, *found], found):
        if v[0] not in spans:
            spans[v[0]] = [v[1], v[1], before[1], before[2], None if before[0] is None else after(before), firsts.get(v[0] + 1)]
        spans[v[0]][1] = v[1]
    table = hull.sparkSession.createDataFrame(
        [(c, *s) for c, s in spans.items()], "_chunk long, _lo double, _hi double, _bx double, _by double, _bnext double, _over double")
    inside = hull.join(bounded_broadcast(table), "_chunk").filter("_x between _lo and _hi").withColumn("_next", F.coalesce("_next", "_over"))
    order = Window.partitionBy("_chunk").orderBy("_x")  # a chunk has no more points than one task should hold
    earlier = lambda c, given: F.coalesce(F.lag(c).over(order), F.col(given))
    edges = inside.select(
        earlier("_next", "_bnext").alias("low"), F.col("_p").alias("high"),
        (F.col("_y") - earlier("_y", "_by")).alias("_s"), (F.col("_x") - earlier("_x", "_bx")).alias("_n"))
    return edges.filter("_n is not null").select("low", "high", (F.col("_s") / F.col("_n")).alias("pd"), F.col("_n").cast("long").alias("n"))


def calibrate(df: DataFrame, blocks: DataFrame, p: str, name: str = "pd") -> DataFrame:
    """`df` with the calibrated probability of the score `p`, linear between the ends of neighbouring blocks.

    Distinct scores and the ends of the blocks are ordered together; running counts tell each score the ends around it.
    """
    ends = blocks.select("pd", F.explode(F.array_distinct(F.array("low", "high"))).alias("_p"))
    scores = df.select(F.col(p).cast("double").alias("_p")).filter("_p is not null").distinct()
    both = ends.select("_p", F.lit(1).cast("long").alias("_end"), "pd").unionByName(scores.select("_p", F.lit(0).cast("long").alias("_end"), F.lit(None).cast("double").alias("pd")))
    placed = cut(running_totals(both.groupBy("_p").agg(F.max("_end").alias("_end"), F.max("pd").alias("pd")), "_p", ["_end"]))
    knots = cut(placed.filter("_end = 1").select(F.col("cum__end").alias("_k"), F.struct("_p", "pd").alias("_at")))
    table = placed.select(F.col("_p"), F.col("cum__end").alias("_k"))
    table = attach(table, knots.withColumnRenamed("_at", "_a"), ["_k"]).withColumn("_k", F.col("_k") + 1)
    table = attach(table, knots.withColumnRenamed("_at", "_b"), ["_k"])
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("_p") - a["_p"]) / (b["_p"] - a["_p"])
    value = F.coalesce(a["pd"] + F.when(b["pd"] != a["pd"], (b["pd"] - a["pd"]) * share).otherwise(0.0), a["pd"], b["pd"])
    found = cut(table.select(F.col("_p").alias("_score"), value.alias(name)))
    return attach(df.withColumn("_score", F.col(p).cast("double")), found, ["_score"]).drop("_score")
