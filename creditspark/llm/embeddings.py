"""Near copies of embeddings by an inverted multi-index.

Index.  Unit vectors are cut in two halves, each with a codebook of its own (k-means on at most about SAMPLE vectors, chosen by
hash); the pairs of codewords are the cells of a grid of about one cell per CELL_ROWS vectors.  Every vector is in the cell nearest to it.

Traversal.  A vector visits the cells in order of distance, the sum of the distances of its halves to both codewords,
until those are visited that are at most `gap` farther away than its own.  The gap is set so that of the hardest links, sampled vectors turned
by exactly the threshold's angle, the share RECALL is found from one end; a link is looked for from both ends.

Verification.  Equal vectors are one node from the start, any number of them.  A node within half of the threshold's angle
of one of the few leaders of its cell joins the leader's ball: all members of a ball are linked with each other, which needs no pairs.
Balls and lone nodes are the units.  Units that meet in a cell are screened by the sign bits of 128 random projections (six
standard deviations of room, about one link in 10**9), then judged by the cosine of their centres in double
precision: alone that is the verdict, of balls it and the radii show that all members are linked or none; otherwise the
members are multiplied in blocks of at most about BLOCK by BLOCK.  Links are counted, never listed within balls.

Defined cases: vectors that are null or zero, or hold a null or non-finite component, link with nothing, nor do vectors of
different lengths; rows with the same id are vectors of their own, and linked if theirs are; a row with a null id has no id
to give to its component and is never kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.common import Shelf
from creditspark.llm.neardup import components

COSINE = 0.9
RECALL = 0.95
SAMPLE = 20_000
CELL_ROWS = 8
WIDEST = 1024
LEADERS = 4
BLOCK = 512
ROUNDS = 8
#: Sampled vectors are turned so often that at least as many hardest links set the gap.
TURNED = 2000
#: Vectors that a task compares with the codebooks at once.
AT_ONCE = 1024
_ROOM = 1e-7


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means on the rows of x; fewer centres if there are fewer rows."""
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        at = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Two codebooks, the gap of the traversal and the projections of the signatures; vectors are padded to `width`."""

    def __init__(self, sample: list[list[float]], width: int, rows: int, least: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, self.half = width, -(-width // 2)
        x = self.units(sample)
        k = int(min(max(2, 2 ** round(np.log2(max(rows / CELL_ROWS, 4)) / 2)), WIDEST))
        self.books = codebook(x[:, :self.half], k, rng), codebook(x[:, self.half:], k, rng)
        self.k = len(self.books[1])
        self.planes = rng.normal(size=(width, 128))
        x = np.repeat(x, -(-TURNED // len(x)), axis=0)
        turned = rng.normal(size=x.shape)
        turned -= (turned * x).sum(1)[:, None] * x
        turned /= np.maximum(np.linalg.norm(turned, axis=1), 1e-300)[:, None]
        turned = least * x + np.sqrt(1 - least**2) * turned
        (a, b), (c, d) = self.halves(x), self.halves(turned)
        at = np.arange(len(x))
        gaps = a[at, c.argmin(1)] + b[at, d.argmin(1)] - a.min(1) - b.min(1)
        self.gap = float(np.quantile(gaps, RECALL))

    def units(self, vectors: list) -> np.ndarray:
        x = np.zeros((len(vectors), self.width))
        for row, v in zip(x, vectors):
            row[:len(v)] = v
        x /= np.abs(x).max(1)[:, None]
        return x / np.linalg.norm(x, axis=1)[:, None]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, :self.half], self.books[0]), _distances(x[:, self.half:], self.books[1])

    def visit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells of the grid, nearest first, whose distance is at most `gap` above the nearest one's."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i], b[j]
        limit = a[0] + b[0] + self.gap
        n = np.searchsorted(b, limit - a[:np.searchsorted(a, limit - b[0], "right")], "right")
        row = np.repeat(np.arange(len(n)), n)
        column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if not len(row):  # rounding
            row = column = np.zeros(1, int)
        order = np.argsort(a[row] + b[column], kind="stable")
        return i[row[order]] * self.k + j[column[order]]


def _sound(x: Column) -> Column:
    return x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)


def _indexed(nodes: DataFrame, index: Index) -> DataFrame:
    """Nodes with their cell, the cells they visit and their signature (s1, s2)."""
    held = nodes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(start, AT_ONCE)
                vectors = b.column("x").to_pylist()
                x = index.units(vectors)
                base = np.array([len(v) for v in vectors], np.int64) * (len(index.books[0]) * index.k)
                first, second = index.halves(x)
                visited = [index.visit(p, q) + n for p, q, n in zip(first, second, base)]
                cell = first.argmin(1) * index.k + second.argmin(1) + base
                bits = np.packbits(x @ index.planes > 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("w"), b.column("x"), pa.array(cell), pa.array(visited, pa.list_(pa.int64())),
                     pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["node", "w", "x", "cell", "visited", "s1", "s2"])

    return nodes.select("node", "w", "x").mapInArrow(run, "node long, w long, x array<double>, cell long, visited array<long>, s1 long, s2 long")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, c: s + c)


def _cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; scaled first, so that squares stay finite."""
    def scaled(v: Column) -> Column:
        return F.transform(v, lambda c: c / F.array_max(F.transform(v, F.abs)))

    def cosine(p: Column, q: Column) -> Column:
        return F.try_divide(_dot(p, q), F.sqrt(_dot(p, p)) * F.sqrt(_dot(q, q)))

    plain = cosine(a, b)
    odd = plain.isNull() | F.isnan(plain) | ~_dot(a, a).between(1e-200, 1e200) | ~_dot(b, b).between(1e-200, 1e200)
    return F.when(odd, cosine(scaled(a), scaled(b))).otherwise(plain)


def _balls(index: DataFrame, least: float, shelf: Shelf) -> DataFrame:
    """index without x, with each node's unit and its angle to the unit's centre."""
    spread = F.xxhash64("node")
    leaders = index.groupBy("cell", F.pmod(spread, F.lit(LEADERS)).alias("_part")).agg(
        F.min_by(F.struct("node", "x"), spread).alias("l")).groupBy(F.col("cell").alias("_cell")).agg(F.collect_list("l").alias("leaders"))
    near = F.array_max(F.transform("leaders", lambda l: F.struct(_cosine(l["x"], F.col("x")).alias("c"), l["node"].alias("unit"))))
    half = float(np.cos(np.arccos(least) / 2 - _ROOM))
    joined = index.join(leaders, F.col("cell") == F.col("_cell")).withColumn("near", near)
    inside = F.col("near.c") >= half
    return shelf.keep(joined.select(
        "node", "w", "cell", "visited", "s1", "s2", F.when(inside, F.col("near.unit")).otherwise(F.col("node")).alias("unit"),
        F.when(inside & (F.col("near.unit") != F.col("node")), F.acos(F.least(F.col("near.c"), F.lit(1.0)))).otherwise(0.0).alias("angle")))


def _candidates(members: DataFrame, units: DataFrame, angle: float) -> DataFrame:
    """i and j, units that meet in a cell and whose signatures allow a link."""
    visits = members.select(F.col("unit").alias("u"), F.explode("visited").alias("c")).distinct()
    a = visits.join(units.select(F.col("unit").alias("u"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("radius").alias("ra")), "u")
    met = a.join(units, (F.col("c") == F.col("cell")) & (F.col("u") != F.col("unit")))
    p = F.least(F.lit(angle) + F.col("ra") + F.col("radius") + 2 * _ROOM, F.lit(float(np.pi))) / float(np.pi)
    bits = F.bit_count(F.col("a1").bitwiseXOR(F.col("s1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("s2")))
    return met.where(bits <= 128 * p + 6 * F.sqrt(128 * p * (1 - p)) + 1).select(
        F.least("u", "unit").alias("i"), F.greatest("u", "unit").alias("j")).distinct()


def _by_members(partial: DataFrame, members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """i, j, node and n (weight of its links) for pairs of units of which only some members may be linked."""
    full = members.select("node", "unit", "w").join(nodes.select("node", "x"), "node")
    blocks = members.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sized = partial.join(blocks.select(F.col("unit").alias("i"), F.col("blocks").alias("ni")), "i").join(
        blocks.select(F.col("unit").alias("j"), F.col("blocks").alias("nj")), "j")

    def side(own: str, mine: str, others: str, first: bool) -> DataFrame:
        rows = sized.join(full, F.col(own) == F.col("unit")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col(mine)))
        rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        bi, bj = ("_b", "_o") if first else ("_o", "_b")
        return rows.select("i", "j", F.col(bi).alias("bi"), F.col(bj).alias("bj"), F.lit(first).alias("first"), "node", "w", "x")

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["first"]], group[~group["first"]]
        if not len(a) or not len(b):
            return group.iloc[:0][["i", "j", "node"]].assign(n=pd.Series(dtype="int64"))
        x, y = (np.array(part["x"].tolist(), float) for part in (a, b))
        x, y = (v / np.abs(v).max(1)[:, None] for v in (x, y))
        hit = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= least
        out = pd.DataFrame({"node": np.r_[a["node"], b["node"]], "n": np.r_[hit @ b["w"].to_numpy(), hit.T @ a["w"].to_numpy()]})
        return out[out["n"] > 0].assign(i=group["i"].iloc[0], j=group["j"].iloc[0])[["i", "j", "node", "n"]]

    both = side("i", "ni", "nj", True).unionByName(side("j", "nj", "ni", False))
    return both.groupBy("i", "j", "bi", "bj").applyInPandas(judged, "i long, j long, node long, n long")


def near_copies(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of `vectors`."""
    shelf, spark = Shelf(vectors.sparkSession), vectors.sparkSession
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", F.when(_sound(F.col("embedding")), x).alias("x")).select(
        "vec_id", "x", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))
    nodes = rows.where("x is not null").groupBy("a", "b").agg(
        F.any_value("x").alias("x"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    nodes = shelf.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"),
                              F.col("vec_id").isNotNull().alias("kept"))
    sample = nodes.where(F.pmod("a", F.lit(-(-n // SAMPLE))) == 0).select("a", "b", "x").collect()  # about SAMPLE vectors
    sample = [r["x"] for r in sorted(sample)] or [nodes.first()["x"]]
    index = shelf.keep(_indexed(nodes, Index(sample, width, n, least)))
    members = _balls(index, least, shelf)
    centres = index.select(F.col("node").alias("unit"), "cell", "s1", "s2", "x")
    units = shelf.keep(members.groupBy("unit").agg(F.sum("w").alias("weight"), F.max("angle").alias("radius")).join(centres, "unit"))
    angle = float(np.arccos(least))
    pairs = shelf.keep(_candidates(members, units.drop("x", "weight"), angle))

    def end(name: str) -> DataFrame:
        return units.select(F.col("unit").alias(name), F.col("x").alias(f"x{name}"), F.col("weight").alias(f"w{name}"), F.col("radius").alias(f"r{name}"))

    cosine, room = _cosine(F.col("xi"), F.col("xj")), F.col("ri") + F.col("rj")
    between = F.acos(F.greatest(F.least(F.col("c"), F.lit(1.0)), F.lit(-1.0)))
    verdict = F.when(room == 0, F.when(F.col("c") >= least, "all")).when(between + room <= angle - _ROOM, "all").when(
        between - room <= angle + _ROOM, "some")
    judged = shelf.keep(pairs.join(end("i"), "i").join(end("j"), "j").withColumn("c", cosine).select(
        "i", "j", "wi", "wj", verdict.alias("verdict")).where("verdict is not null"))
    some = shelf.keep(_by_members(judged.where("verdict = 'some'").select("i", "j"), members, nodes, least))
    whole = judged.where("verdict = 'all'")
    labels = components(whole.select("i", "j").unionByName(some.select("i", "j").distinct()).select(
        F.col("i").alias("node"), F.col("j").alias("centre")), shelf)
    by_unit = whole.select(F.col("i").alias("unit"), F.col("wj").alias("n")).unionByName(
        whole.select(F.col("j").alias("unit"), F.col("wi").alias("n"))).groupBy("unit").agg(F.sum("n").alias("linked"))
    by_node = some.groupBy("node").agg(F.sum("n").alias("more"))
    zero = F.lit(0).cast("long")
    told = units.select("unit", "weight").join(by_unit, "unit", "left").join(
        labels.select(F.col("node").alias("unit"), "label"), "unit", "left").select(
        "unit", (F.col("weight") - 1 + F.coalesce("linked", zero)).alias("n"), F.coalesce("label", "unit").alias("label"))
    known = members.select("node", "unit").join(told, "unit").join(by_node, "node", "left").join(nodes.select("node", "a", "b", "least"), "node")
    known = shelf.keep(known.select("a", "b", "label", "least", (F.col("n") + F.coalesce("more", zero)).alias("n_links")))
    heads = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(heads, "label").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n_links", F.col("component_id").cast("long").alias("component_id"))
    out = rows.join(known, F.col("x").isNotNull() & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select(
        "vec_id", F.coalesce("n_links", zero).alias("n_links"),
        F.when(F.col("x").isNull(), F.col("vec_id").cast("long")).otherwise(F.col("component_id")).alias("component_id"))
    return shelf.close(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
