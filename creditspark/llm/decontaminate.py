"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of distinct five-word shingles into classes of doubling size.  An
item keeps a bottom sketch, the SKETCH smallest of its shingle names; all shingles count for items that have fewer.  The shingles
of a class's sketches lie below a rank limit of about SKETCH / size, so that a document's own
MinHash sample for the class is its shingles below that limit: a long document keeps a sample in
proportion to its size, which is what finds a short item inside a long text (a signature of
fixed size would not).  Documents are partitioned by size too: a document probes only classes whose
items it is large enough to contain.

An item is a candidate for a document if NEED quarters of its sketch are found in the sample.  At
a containment of 0.8 a sketch of 16 has fewer than 4 hits with a probability below 1e-7.  Candidates are verified
by exact containment: |shingles of item and document| / |shingles of item| >= 0.8.

The documents are read once, without a shuffle, per block of items.  A block holds at most BLOCK
shingles (8 bytes each plus sketches), whatever the size of the benchmark, and is broadcast.  What a block finds is stored and the
block is given up before the next one is read; only the last block waits for the caller.

Defined cases: null and empty texts match nothing; items of fewer than five words have no five-word shingle and match nothing;
equal items are each reported; repeated documents are each reported; an empty benchmark gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm import words as W
from creditspark.llm.common import pieces, stored

CONTAINMENT = 0.8
SKETCH = 16
NEED = 4
#: Item shingles broadcast at once.
BLOCK = 1 << 20


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item and names, the sorted distinct five-word shingles of each item that has any."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            names, bounds = W.words(*W.lowered(b.column("text")))
            values, at = W.shingles(names, bounds)
            rows = [np.unique(values[p:q]).view(np.int64) if n >= W.SIZE else []
                    for p, q, n in zip(at[:-1], at[1:], np.diff(bounds))]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(rows, pa.list_(pa.int64()))], ["item", "names"])

    return benchmark.select("item_id", "text").mapInArrow(made, f"item {kind}, names array<long>").where("size(names) > 0")


class Block:
    """Items of a block, their shingles and their sketches, looked up by sorted arrays."""

    def __init__(self, items: list, sets: list[np.ndarray]):
        self.items = items
        self.sizes = np.array([len(s) for s in sets])
        self.classes = np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(int)
        sketch = [s[:SKETCH] for s in sets]  # the smallest names
        self.need = np.array([max(1, len(s) * NEED // SKETCH) for s in sketch])
        self.by_class = {}
        for c in np.unique(self.classes):
            mine = np.flatnonzero(self.classes == c)
            names = np.concatenate([sketch[i] for i in mine])
            owner = np.repeat(mine, [len(sketch[i]) for i in mine])
            order = np.argsort(names, kind="stable")
            least = int(np.ceil(CONTAINMENT * self.sizes[mine].min() - 1e-9))
            self.by_class[int(c)] = (names[order], owner[order], names.max(), least)
        self.sets = sets

    def matches(self, document: np.ndarray) -> list[tuple[int, int]]:
        """(item position, shared shingles) of the items contained in a document of sorted distinct shingles."""
        found = []
        for names, owner, limit, least in self.by_class.values():
            if len(document) < least:
                continue
            sample = document[:np.searchsorted(document, limit, "right")]
            at = np.searchsorted(sample, names)
            hit = at < len(sample)
            hit[hit] = sample[at[hit]] == names[hit]
            if not hit.any():
                continue
            which, hits = np.unique(owner[hit], return_counts=True)
            for i in which[hits >= self.need[which]]:
                shared = len(np.intersect1d(self.sets[i], document, assume_unique=True))
                if shared >= CONTAINMENT * self.sizes[i] - 1e-9:
                    found.append((int(i), shared))
        return found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[Broadcast, bool]]:
    """Blocks of at most `limit` shingles (one item at least), broadcast one after the other, and whether it is the last.

    All but the last are destroyed when the next one is asked for, so what needs them has to be done by then.
    """
    context = benchmark.sparkSession.sparkContext
    shingles = stored(item_shingles(benchmark))
    items, sets, total = [], [], 0
    for row in shingles.toLocalIterator():
        names = np.array(row["names"], np.int64).view(np.uint64)
        if total and total + len(names) > limit:
            held = context.broadcast(Block(items, sets))
            items, sets, total = [], [], 0
            yield held, False
            held.destroy(blocking=True)
            del held
        items.append(row["item"])
        sets.append(np.sort(names))
        total += len(names)
    if items:
        yield context.broadcast(Block(items, sets)), True


def contained(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, shared and containment of every item found in a document."""
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, shared int, containment double"

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for b in pieces(batches, "text"):
                ids, found = b.column("doc_id").to_pylist(), []
                for doc_id, document in zip(ids, W.shingle_sets(b.column("text"))):
                    found += [(doc_id, block.items[i], n, n / block.sizes[i]) for i, n in block.matches(document)]
                columns = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], b.column("doc_id").type), pa.array(columns[1], pa_type(item_type)),
                     pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())],
                    ["doc_id", "item_id", "shared", "containment"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = []
    for held, last in _blocks(benchmark, block):
        parts.append(search(held) if last else stored(search(held)))
        del held
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def pa_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, all columns, that contain no item; one pass over the texts per block, no join on the id.

    The last block filters the rows as they pass; those before it leave the digests of the texts that contain an item.
    """
    columns, kept = docs.columns, docs

    def clean(held, good):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                keep = [good != bool(held.value.matches(s)) for s in W.shingle_sets(b.column("text"))]
                yield b.filter(pa.array(keep, pa.bool_())).select(columns if good else ["text"])

        return run

    gone = []
    for held, last in _blocks(benchmark, block):
        if last:
            kept = kept.mapInArrow(clean(held, True), docs.schema)
        else:
            found = docs.select("text").mapInArrow(clean(held, False), "text string")
            gone.append(stored(found.select(F.sha2("text", 256).alias("digest")).distinct()))
        del held
    if gone:
        digests = reduce(DataFrame.unionByName, gone)
        kept = kept.join(digests, F.sha2(kept["text"], 256) == digests["digest"], "left_anti")
    return kept
