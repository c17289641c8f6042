"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block of queries by block of queries (at most BLOCK, broadcast).  A
pass over the candidates counts each query's scores in BINS equal bins between bounds that hold all its scores; the
counts are added up by Spark, and the bin that holds the kth highest score becomes the next pass's range, until
bins are one score wide.  A task only reports its highest bins, as far as its own counts reach k: lower bins cannot
hold the kth value.  A last pass keeps scores above the kth value and, of those equal to it, the smallest
ids; so ties, however many, are cut by id inside each task before they are shuffled.

Components are integers floor(256 * x); products are exact: in double precision where they stay below
2**53, else as 64-bit integers.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows with a null
id; vectors of different lengths have no score; rows with the query's id are the query's own; a repeated query id
is searched once, with its smallest vector; a query with fewer than k candidates returns them all;
extra columns are ignored; vectors so long (2**31 after scaling) that a score could
pass 62 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.common import Shelf

K = 5
#: Queries scored in one pass.
BLOCK = 2048
BINS = 1024
#: Candidates multiplied at once inside a task.
CHUNK = 1024
_EXACT = 2.0**53


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the integer components, of the rows that take part."""
    x = F.col("embedding")
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


class Block:
    """Queries of one pass by vector length, and the range in which each one's kth score is looked for."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], longest: float, k: int):
        self.ids = np.array(ids, np.int64)
        self.by_length = {}
        for n in {len(v) for v in vectors}:
            at = np.array([i for i, v in enumerate(vectors) if len(v) == n])
            self.by_length[n] = (at, np.array([vectors[i] for i in at], np.int64).reshape(len(at), n))
        norms = np.sqrt([float((v.astype(float) ** 2).sum()) for v in vectors])
        bound = np.ceil(norms * longest * (1 + 1e-9)).astype(np.int64) + 1
        self.exact = bool((bound < _EXACT).all())
        self.low = -bound
        self.span = 2 * bound + 1  # scores from low on among which the kth is
        self.width = -(-self.span // BINS)
        self.need = np.full(len(ids), k)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions of queries, candidate ids in order, scores) for the candidates of a batch, by vector length."""
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        column = batch.column("v")
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        for n, (at, queries) in self.by_length.items():
            rows = np.flatnonzero(lengths == n)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            for i in range(0, len(rows), CHUNK):
                part = rows[i:i + CHUNK]
                taken = flat[(offsets[part][:, None] + np.arange(n)).reshape(-1)].reshape(len(part), n)
                made = (queries.astype(float) @ taken.T.astype(float)) if self.exact else queries @ taken.T
                yield at, ids[part], made


def _histogram(candidates: DataFrame, held, k: int) -> DataFrame:
    """query (its position), bin and n: the counts of the scores inside each query's range, highest bins first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        counts = np.zeros((len(block.ids), BINS), np.int64)
        width = np.maximum(block.width, 1)
        for batch in batches:
            for at, ids, s in block.scores(batch):
                bins = ((s - block.low[at][:, None]) // width[at][:, None]).astype(np.int64)
                inside = (bins >= 0) & (s - block.low[at][:, None] < block.span[at][:, None]) & (ids[None, :] != block.ids[at][:, None])
                q, c = np.nonzero(inside)
                counts += np.bincount(at[q] * BINS + bins[q, c], minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _narrow(candidates: DataFrame, block: Block, k: int) -> None:
    """Narrow each query's range to the one score that is its kth highest (width 0), or to nothing (need 0)."""
    spark = candidates.sparkSession
    from_above = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        open_ = np.flatnonzero((block.width > 0) & (block.need > 0))
        if not len(open_):
            return
        held = spark.sparkContext.broadcast(block)
        needs = spark.createDataFrame([(int(q), int(block.need[q])) for q in open_], "query int, need long")
        found = _histogram(candidates, held, k).withColumn("upto", F.sum("n").over(from_above)).join(
            F.broadcast(needs), "query").where("upto >= need and upto - n < need")  # one row per query, BLOCK at most
        hits = {r["query"]: r for r in found.collect()}
        for q in open_:
            hit = hits.get(int(q))
            if hit is None:  # fewer than k candidates: all of them are wanted
                block.need[q], block.low[q] = 0, np.iinfo(np.int64).min
                continue
            block.need[q] -= hit["upto"] - hit["n"]
            block.low[q] += hit["bin"] * block.width[q]
            block.span[q] = block.width[q]
            block.width[q] = 0 if block.span[q] == 1 else -(-block.span[q] // BINS)
        held.unpersist()


def _selected(candidates: DataFrame, block: Block, k: int) -> DataFrame:
    """All scores above the kth value, and of those equal to it the smallest ids, ranked."""
    held = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for at, ids, s in block.scores(batch):
                low, need = block.low[at][:, None], block.need[at][:, None]
                other = ids[None, :] != block.ids[at][:, None]
                tied = (s == low) & other
                tied &= np.cumsum(tied, axis=1) <= need  # ids are in order
                q, c = np.nonzero(((s > low) & other) | tied)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[at[q]]), pa.array(ids[c]), pa.array(s[q, c].astype(np.int64))],
                    ["query_id", "vec_id", "score"])

    kept = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, longest: float, k: int, size: int) -> Iterator[Block]:
    """Blocks of queries; the driver holds one at a time."""
    ids, vectors = [], []
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        vectors.append(np.array(row["v"], np.int64))
        if len(ids) == size:
            yield Block(ids, vectors, longest, k)
            ids, vectors = [], []
    if ids:
        yield Block(ids, vectors, longest, k)


def search(vectors: DataFrame, every: int = 50, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest scores of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`.
    """
    shelf = Shelf(vectors.sparkSession)
    rows = shelf.keep(quantized(vectors))
    queries = shelf.keep(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    found = False
    longest = float(np.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0))
    if longest**2 >= 2.0**62:
        raise ValueError("components are too large: scores would not fit into 64 bits")
    path = f"{shelf.folder}/found"
    for b in _blocks(queries, longest, k, block):
        _narrow(rows, b, k)
        _selected(rows, b, k).write.mode("append").parquet(path)  # a block is written once
        found = True
    shelf.drop(rows, queries)
    schema = "query_id long, rank int, vec_id long, score long"
    return vectors.sparkSession.read.schema(schema).parquet(path) if found else vectors.sparkSession.createDataFrame([], schema)
