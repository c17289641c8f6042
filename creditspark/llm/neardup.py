"""Near-duplicate documents by DartMinHash signatures and banded joining.

Darts.  Every shingle owns a plane of weight (from 0) by rank (from 0).  Darts hit that plane as
a Poisson process of density one that is a pure function of the shingle's name.  The process is laid out in
regions of doubling width: region r spans the weights from 2**r - 1 to 2**(r+1) - 1, its darts come
in order of rank.  A document with weight x for the shingle sees the darts below x; each of its
darts falls on one of the K coordinates, and the earliest dart of a coordinate is the signature there.
Two documents agree on a coordinate with probability equal to their weighted Jaccard similarity.
Only darts up to a rank limit of about (K ln K + 2 K) / (total weight) are made, so that a
signature costs about one hash per shingle; documents with an empty coordinate double the limit.

Bands.  ROWS coordinates make a band, documents that share a band meet in a bucket.  At similarity 0.8 a
pair misses all bands with probability 2e-4, at 0.85 with 2e-6; at 0.4 it meets with 6 %.

Links.  Documents with equal shingle sets are one node from the start (pre-aggregated, any number of copies).  Pairs of a bucket are
screened inside tasks by one byte per coordinate: a pair goes on if as many agree as at similarity 0.8, less four standard deviations
(which 3e-5 of the pairs at 0.8 miss), and is judged by the exact weighted Jaccard similarity of the two texts.  Classes are
the connected components of the links.  In the first turn every node is compared with one centre per bucket (per block of a large one),
which links most copies.  In the second all nodes of a bucket that are still in different classes are compared with each other, in blocks of at most BLOCK
by BLOCK nodes; nodes of the bucket's largest class are not compared with each other.  A pair counts in the first bucket that it shares.  What is
written are the nodes of a block that have a partner there, not the pairs.  Their texts are brought to the blocks (to parts of at most about LOAD
shingles a side), where all pairs of different classes are judged at once; a link joins its two classes, so a block writes
fewer links than it has classes.  Copies, and texts much like them that link with none, never expand into rows of pairs.

Defined cases: a null text counts as empty; texts without words are in one class exactly if they are equal; rows
that share a doc_id count as one document, a null doc_id has no partners and class null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm import words as W
from creditspark.llm.common import Shelf, pieces, stored, unused

ROWS, BANDS = 7, 36
COORDINATES = ROWS * BANDS
SIMILARITY = 0.8
_ONE = np.uint64(1)
#: Ids up to which a table of ids is broadcast: 8 bytes each.
BROADCAST_IDS = 500_000
#: Nodes of a bucket that are compared with one centre, and nodes that are compared with each other, at once.
STAR, BLOCK = 4096, 512
#: Coordinates of two signatures compared at once.
COMPARED = 1 << 23
#: Shingles of the texts on either side that are judged at once.
LOAD = 1 << 20
#: Darts held at once while signatures are made, about; short texts have as many darts each as long ones.
DARTS = 1 << 17
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _salt(i: int) -> np.uint64:
    return np.uint64(i * int(W.BASE) & 0xFFFFFFFFFFFFFFFF)


def weights(names: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their weights: 1 each, or their number of occurrences."""
    distinct, counts = np.unique(names, return_counts=True)
    return distinct, np.ones(len(distinct)) if kind == "set" else counts.astype(float)


def _earliest(seen: list, rank: np.ndarray, out: np.ndarray) -> None:
    """Take darts (document, rank, name) into the earliest darts so far: rank and name per coordinate, ties to the smaller name."""
    o, r, dart = (np.concatenate(x) for x in zip(*seen))
    cell = o * out.shape[1] + (dart % np.uint64(out.shape[1])).astype(np.int64)
    best, names_at = rank.reshape(-1), out.reshape(-1)
    before = best[cell]
    np.minimum.at(best, cell, r)
    names_at[cell[best[cell] < before]] = _NONE
    first = np.flatnonzero(r == best[cell])
    np.minimum.at(names_at, cell[first], dart[first])


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of `coordinates` dart names per non-empty weighted set."""
    out = np.full((len(sets), coordinates), _NONE)
    rank = np.full((len(sets), coordinates), np.inf)
    todo = np.arange(len(sets))
    darts = coordinates * (np.log(coordinates) + 2.0)
    limit = np.array([darts / w.sum() for _, w in sets])
    while len(todo):
        names = np.concatenate([sets[i][0] for i in todo])
        heavy = np.concatenate([sets[i][1] for i in todo])
        owner = np.repeat(todo, [len(sets[i][0]) for i in todo])
        seen, held, region = [], 0, 0
        while len(names):  # one turn per region of doubling width
            width = float(1 << region)
            key = W.mix(names + _salt(region + 1))
            low, at, step = width - 1.0, np.zeros(len(names)), 0
            k, o, h = key, owner, heavy
            while len(k):  # one turn per dart of a region, in order of rank
                draw = W.mix(k + _salt(2 * step + 1))
                at = at - np.log(_unit(draw)) / width
                on = at <= limit[o]
                k, o, h, at, draw = k[on], o[on], h[on], at[on], draw[on]
                place = W.mix(draw ^ W.BASE)
                hit = low + width * _unit(place) <= h
                seen.append((o[hit], at[hit], W.mix(place + _ONE)[hit]))
                held += len(seen[-1][0])
                if held >= DARTS:
                    _earliest(seen, rank, out)
                    seen, held = [], 0
                step += 1
            more = heavy > 2.0 * width - 1.0
            names, owner, heavy, region = names[more], owner[more], heavy[more], region + 1
        if seen:
            _earliest(seen, rank, out)
        todo = todo[np.isinf(rank[todo]).any(1)]
        limit[todo] *= 2.0
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """One name per band of a signature, distinct from band to band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    made = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        made = made * W.BASE + parts[:, :, j]
    return W.mix(made.reshape(-1)).reshape(made.shape).view(np.int64)


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def sketches(docs: DataFrame, kind: str = "set") -> DataFrame:
    """doc_id, a 128-bit name (f1, f2) of the weighted shingle set, the band names and `sig`, a byte per coordinate (none without words), and the
    number of shingles, repeats included."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            text = b.column("text")
            names, bounds = W.shingles(*W.words(*W.lowered(text)))
            sets = [weights(names[p:q], kind) for p, q in zip(bounds[:-1], bounds[1:])]
            f1 = np.zeros(len(sets), np.uint64)
            f2 = np.zeros(len(sets), np.uint64)
            full = [i for i, s in enumerate(sets) if len(s[0])]
            bands: list = [[] for _ in sets]
            small: list = [None] * len(sets)
            for i, s in enumerate(sets):
                if len(s[0]):
                    own = W.mix(s[0] + s[1].astype(np.uint64) * W.BASE)
                    f1[i], f2[i] = own.sum(dtype=np.uint64), W.mix(own ^ W.BASE).sum(dtype=np.uint64)
                else:
                    raw = np.frombuffer((text[i].as_py() or "").encode(), np.uint8)
                    n = len(raw)
                    f1[i] = W.range_names(raw, np.array([0]), np.array([n]))[0] if n else np.uint64(1)
                    f2[i] = np.uint64(n)
            if full:
                sig = signatures([sets[i] for i in full])
                for i, row, byte in zip(full, _bands(sig), (sig >> np.uint64(40)).astype(np.uint8)):
                    bands[i], small[i] = row, byte.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), _longs(f1), _longs(f2), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary()),
                 pa.array(np.diff(bounds), pa.int64())],
                ["doc_id", "f1", "f2", "bands", "sig", "size"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        made, f"doc_id {kind_of_id}, f1 long, f2 long, bands array<long>, sig binary, size long")


def _similar(pairs: DataFrame, texts: DataFrame, least: float, kind: str) -> DataFrame:
    """Of the pairs (node, centre) those whose texts have a weighted Jaccard similarity of `least` or more."""
    a = texts.select(F.col("doc_id").alias("node"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("text_b"))
    both = pairs.join(_merge(a), "node").join(_merge(b), "centre").select("node", "centre", "text_a", "text_b")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for b in pieces(iter([batch]), "text_a"):
                nodes, centres = b.column("node").to_pylist(), b.column("centre").to_pylist()
                names, bounds = W.shingles(*W.words(*W.lowered(b.column("text_a"))))
                good = []
                for i, centre in enumerate(centres):
                    if centre != last:  # the sorted join brings the pairs of a centre together
                        kept = weights(W.shingles(*W.words(*W.lowered(b.column("text_b").slice(i, 1))))[0], kind)
                        last = centre
                    s, v = weights(names[bounds[i]:bounds[i + 1]], kind)
                    _, p, q = np.intersect1d(s, kept[0], assume_unique=True, return_indices=True)
                    shared = np.minimum(v[p], kept[1][q]).sum()
                    good.append(shared >= least * (v.sum() + kept[1].sum() - shared) - 1e-9 and shared > 0)
                on = [i for i, x in enumerate(good) if x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in on], b.column("node").type),
                     pa.array([centres[i] for i in on], b.column("centre").type)], ["node", "centre"])

    t = pairs.schema["node"].dataType.simpleString()
    return both.mapInArrow(judged, f"node {t}, centre {t}").distinct()


def _merge(df: DataFrame) -> DataFrame:
    """For joins in loops: both sides are sorted and merged, no tables pile up on the driver."""
    return df.hint("merge")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one label and no label hangs on another."""
    tops = edges.select(F.col("v").alias("t")).distinct()
    chained = edges.join(_merge(tops), F.col("u") == F.col("t"), "left_semi").select("u")
    forked = edges.groupBy("u").count().where("count > 1").select("u")
    return chained.unionByName(forked).limit(1).isEmpty()


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """node and label, the smallest node of its component, from links (node, centre) of any direction.

    Alternating stars: each node's larger neighbours, then its smaller ones, hang on to its smallest neighbour, until
    all links lead to the label.  The tables stay distributed; a node with many links
    is one side of a join that can be split, since both sides are stored.  Tables of earlier turns are deleted.
    """
    edges = shelf.keep(links.select(
        F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shelf.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(_merge(least), F.col("u") == F.col("w"))
        large = shelf.keep(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        below = shelf.keep(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"))
        small = large.join(_merge(below), F.col("u") == F.col("w")).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        further = shelf.keep(small.where("u <> v").distinct())
        shelf.drop(edges, least, large, below)
        edges = further
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _with_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.withColumnRenamed("node", "_n")
    return df.join(_merge(known), F.col("node") == F.col("_n"), "left").drop("_n").withColumn(
        "label", F.coalesce("label", "node"))


def _few(df: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def least_agreement(least: float, coordinates: int = COORDINATES) -> int:
    """Coordinates that agree at similarity `least`, less four standard deviations."""
    return max(int(np.ceil(coordinates * least - 4 * np.sqrt(coordinates * least * (1 - least)))), 1)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch per group of rows that stand together with equal keys."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            own = tuple(c[i] for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = own
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _pairs_out(ids: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["node", "centre"])


def _star_pairs(met: DataFrame, groups: DataFrame, need: int) -> DataFrame:
    """Nodes and the centre of their block of a bucket that agree in `need` coordinates; another centre in every bucket."""
    block = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / STAR))
    rows = met.withColumn("block", block).join(_merge(groups.select(F.col("node").alias("_n"), "sig")), F.col("node") == F.col("_n")).select(
        "bucket", "block", F.xxhash64("bucket", "node").alias("turn"), "node", "sig")
    rows = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "turn", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["bucket", "block"]):
            sig = _bytes(g.column("sig"))
            near = np.flatnonzero((sig == sig[0]).sum(1) >= need)
            near = near[near > 0]
            if len(near):
                yield _pairs_out(g.column("node"), near, np.zeros(len(near), np.int64))

    t = met.schema["node"].dataType.simpleString()
    return rows.mapInArrow(run, f"node {t}, centre {t}").select(F.greatest("node", "centre").alias("node"), F.least("node", "centre").alias("centre")).distinct()


def _screened(g: pa.RecordBatch, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the left and of the right side of a block that agree in `need` coordinates and differ in label."""
    sig, label = _bytes(g.column("sig")), g.column("label").to_numpy()
    left, right = (np.flatnonzero(g.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    if not len(left) or not len(right):
        return
    step = max(COMPARED // (len(right) * sig.shape[1]), 1)
    for at in range(0, len(left), step):
        a = left[at:at + step]
        hit = (sig[a][:, None, :] == sig[right][None, :, :]).sum(2) >= need
        hit &= label[a][:, None] != label[right]
        p, q = np.nonzero(hit)
        if len(p):
            yield a[p], right[q]


def _cross_pairs(placed: DataFrame, groups: DataFrame, need: int, shelf: Shelf, places: bool = False) -> DataFrame:
    """Nodes of a bucket with different labels that agree in `need` coordinates.

    With `places` not the pairs, but once per block (bucket, k, i, j) the nodes that have a partner there, and on which sides; a pair
    counts in the first bucket that both nodes share.
    """
    per = placed.groupBy("bucket", "label").count().groupBy("bucket").agg(
        F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("labels"))
    open_ = shelf.keep(per.where("labels > 1").select(
        F.col("bucket").alias("_b"), F.col("most.label").alias("main"),
        F.ceil(F.col("most.count") / BLOCK).alias("mains"), F.ceil((F.col("n") - F.col("most.count")) / BLOCK).alias("others")))
    rows = placed.join(_merge(open_), F.col("bucket") == F.col("_b")).withColumn("of_main", F.col("label") == F.col("main"))
    spread = F.xxhash64("node", "bucket")
    own = F.when(F.col("of_main"), F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # blocks of the largest class meet all blocks of the others (0, i, j), those meet each other (1, i, j) with i <= j
    first = F.transform(upto(F.col("others")), lambda j: F.struct(F.lit(0).alias("k"), F.col("own").alias("i"), j.alias("j")))
    second = F.concat(
        F.transform(upto(F.col("mains")), lambda i: F.struct(F.lit(0).alias("k"), i.alias("i"), F.col("own").alias("j"))),
        F.transform(upto(F.col("others")), lambda o: F.struct(
            F.lit(1).alias("k"), F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"))))
    rows = rows.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("of_main"), first).otherwise(second)))
    more = ["bands", "size"] if places else []
    rows = rows.join(_merge(groups.select(F.col("node").alias("_n"), "sig", *more)), F.col("node") == F.col("_n"))
    rows = rows.select(
        "bucket", "at.k", "at.i", "at.j", (F.col("of_main") | ((F.col("at.k") == 1) & (F.col("own") == F.col("at.i")))).alias("left"),
        (~F.col("of_main") & ((F.col("at.k") == 0) | (F.col("own") == F.col("at.j")))).alias("right"),
        F.xxhash64("label").alias("label"), "node", "sig", *more)
    rows = rows.repartition("bucket", "k", "i", "j").sortWithinPartitions("bucket", "k", "i", "j", "node")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["bucket", "k", "i", "j"]):
            for a, b in _screened(g, need):
                yield _pairs_out(g.column("node"), a, b)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["bucket", "k", "i", "j"]):
            bands = g.column("bands").flatten().to_numpy().reshape(g.num_rows, -1)
            code = g.column("node").dictionary_encode().indices.to_numpy()
            left, right = np.zeros((2, g.num_rows), bool)
            for a, b in _screened(g, need):
                shared = bands[a] == bands[b]
                here = bands[a, shared.argmax(1)] == g.column("bucket")[0].as_py()
                here &= shared.any(1)
                left[code[a[here]]] = right[code[b[here]]] = True
            once, at = np.unique(code, return_index=True)
            at = at[left[once] | right[once]]
            if len(at):
                on = g.select(["bucket", "k", "i", "j", "label", "node", "size"]).take(pa.array(at))
                yield on.append_column("left", pa.array(left[code[at]])).append_column("right", pa.array(right[code[at]]))

    t = placed.schema["node"].dataType.simpleString()
    if places:
        return rows.mapInArrow(met, f"bucket long, k int, i long, j long, label long, node {t}, size long, left boolean, right boolean")
    return rows.mapInArrow(pairs, f"node {t}, centre {t}").select(F.greatest("node", "centre").alias("node"), F.least("node", "centre").alias("centre")).distinct()


def _joining(g: pa.RecordBatch, least: float, kind: str) -> tuple[list[int], list[int]]:
    """Rows of the two sides whose texts are similar: links enough to join all classes that any link of the two sides joins."""
    names, bounds = W.shingles(*W.words(*W.lowered(g.column("text"))))
    sets = [weights(names[p:q], kind) for p, q in zip(bounds[:-1], bounds[1:])]
    total = np.array([v.sum() for _, v in sets])
    left, right = (np.flatnonzero(g.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    label = np.unique(g.column("label").to_numpy(), return_inverse=True)[1]
    nodes, centres = [], []
    if not len(left) or not len(right):
        return nodes, centres
    # the right side's shingles in order of their names, and whose they are
    name = np.concatenate([sets[y][0] for y in right])
    order = np.argsort(name, kind="stable")
    name = name[order]
    owner = np.repeat(right, [len(sets[y][0]) for y in right])[order]
    weight = np.concatenate([sets[y][1] for y in right])[order]
    for x in left:
        s, v = sets[x]
        low = np.searchsorted(name, s, "left")
        n = np.searchsorted(name, s, "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], np.minimum(weight[at], np.repeat(v, n)), len(sets))
        near = (shared >= least * (total + total[x] - shared) - 1e-9) & (shared > 0) & (label != label[x])
        for y in np.flatnonzero(near):
            if label[y] != label[x]:
                nodes.append(int(x))
                centres.append(int(y))
                label[label == label[y]] = label[x]
    return nodes, centres


def _cross_links(places: DataFrame, texts: DataFrame, least: float, kind: str) -> DataFrame:
    """Links (node, centre) between the labels of each block of `places`, judged on the texts; heavy blocks in parts."""
    block = Window.partitionBy("bucket", "k", "i", "j")
    parts = lambda side: F.greatest(F.ceil(F.sum(F.when(F.col(side), F.col("size"))).over(block) / LOAD), F.lit(1).cast("long"))
    rows = places.withColumn("lefts", parts("left")).withColumn("rights", parts("right"))
    # a node of the left side meets all parts of the right side (p, q), one of the right side all parts of the left side
    spread = F.xxhash64("node", "bucket", "i", "j")
    rows = rows.withColumn("p", F.pmod(spread, "lefts")).withColumn("q", F.pmod(spread, "rights"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_left = F.transform(upto(F.col("rights")), lambda q: F.struct(
        F.col("p").alias("p"), q.alias("q"), F.lit(True).alias("left"), (F.col("right") & (q == F.col("q"))).alias("right")))
    as_right = F.transform(
        F.filter(upto(F.col("lefts")), lambda p: ~F.col("left") | (p != F.col("p"))), lambda p: F.struct(
            p.alias("p"), F.col("q").alias("q"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    cells = F.when(F.col("left") & F.col("right"), F.concat(as_left, as_right)).when(F.col("left"), as_left).otherwise(as_right)
    rows = rows.select("bucket", "k", "i", "j", "label", "node", F.explode(cells).alias("at"))
    rows = rows.select("bucket", "k", "i", "j", "at.p", "at.q", "at.left", "at.right", "label", "node")
    rows = rows.join(_merge(texts.select(F.col("doc_id").alias("_n"), "text")), F.col("node") == F.col("_n")).drop("_n")
    key = ["bucket", "k", "i", "j", "p", "q"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, key):
            a, b = _joining(g, least, kind)
            if a:
                yield _pairs_out(g.column("node"), np.array(a), np.array(b))

    t = places.schema["node"].dataType.simpleString()
    return rows.mapInArrow(run, f"node {t}, centre {t}").distinct()


def _labels(met: DataFrame, groups: DataFrame, texts: DataFrame, least: float, kind: str, shelf: Shelf) -> DataFrame:
    """Labels of the nodes that meet in the buckets of `met` (bucket, node, n)."""
    need = least_agreement(least)
    tested = shelf.keep(_star_pairs(met, groups, need))
    links = shelf.keep(_similar(tested, texts, least, kind))
    placed = shelf.keep(_with_label(met.select("bucket", "node"), components(links, shelf)))
    found = shelf.keep(_cross_links(shelf.keep(_cross_pairs(placed, groups, need, shelf, places=True)), texts, least, kind))
    return components(links.unionByName(found), shelf)


def _classes(docs: DataFrame, least: float, kind: str, shelf: Shelf) -> DataFrame:
    base = shelf.keep(sketches(docs, kind))
    groups = shelf.keep(base.where("doc_id is not null").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.max("size").alias("size")))
    members = groups.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = shelf.keep(members.join(_merge(buckets), F.col("bucket") == F.col("_b")).select("bucket", "node", "n"))
    wanted = _few(shelf.keep(met.select(F.col("node").alias("_id")).distinct()))
    texts = shelf.keep(docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"), "left_semi"))
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = shelf.keep(texts.distinct())
    named = _with_label(groups.select("f1", "f2", "node"), _labels(met, groups, texts, least, kind, shelf))
    out = base.select("doc_id", "f1", "f2").join(_merge(named), ["f1", "f2"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("class_id"))


def classes(docs: DataFrame, least: float = SIMILARITY, kind: str = "set") -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class), one row per row of `docs`."""
    shelf = Shelf(docs.sparkSession)
    return shelf.close(_classes(docs, least, kind, shelf))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest doc_id, all columns; rows without a doc_id stay."""
    found = classes(docs, least)
    gone, twice = unused(docs, "_gone"), unused(docs, "_twice")
    ids = _few(stored(found.where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct()))
    kept = docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
    ids = stored(found.where("doc_id = class_id").groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice))
    if ids.isEmpty():
        return kept
    again = F.col("doc_id") == F.col(twice)
    return kept.join(ids, again, "left_anti").unionByName(kept.join(ids, again, "left_semi").dropDuplicates(["doc_id"]))
