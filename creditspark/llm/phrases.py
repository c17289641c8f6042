"""Phrase collocations by tries of Apriori-safe candidates, advanced level by level over all text positions.

Words are counted first (in tasks, then by Spark).  Words of at least LEAST occurrences get numbers, and the texts become
rows of word numbers, in which 0 is a rare word or the end of a piece.  A phrase of k words can only be frequent if its
first and its last k - 1 words are; where both are accepted at neighbouring positions the phrase is a candidate.  The
candidates are the edges (node of the first k - 1 words, last word) of a trie, laid out as a double array and broadcast.
A pass advances the states of all positions of a batch at once by one level, counts the accepting states with
bincount, and Spark adds up the counts of all tasks.  The states are stored, so a level is one step, not a walk
from the root.  Dictionary and trie are broadcast in shards of at most SHARD entries, however many there are; one pass over the
texts takes all shards of the dictionary, or AT_ONCE shards of the trie, of which a task holds one at a time.

Scores compare a phrase with its parts: floor(SCALE * a / (l + r)) over all cuts in two parts, where a, l and r are the
counts of the phrase and of the parts.  A phrase is dropped if a longer candidate that contains it has at least
COVER % of its count; counts of longer phrases only fall, so phrases that are one word longer decide.

Defined cases: a null text is empty, a null language is `und`; repeated rows count as often as they stand there;
rows without words add nothing; ties go by count and then phrase in byte order; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.common import Shelf, numbered, pieces

LONGEST = 4
LEAST = 30
COVER = 80
TOP = 2000
SCALE = 2_000_000
#: Words, or edges of the trie, that are broadcast at once.
SHARD = 500_000
#: Shards of the trie that one pass over the rows takes, one after the other.
AT_ONCE = 8
#: Bytes of text whose words a task numbers together if the dictionary has several shards.
GROUP = 1 << 24
#: Positions that a task counts for each edge it may report, so that counts stay few beside the text.
POSITIONS = 64
#: Distinct words a task counts before it hands them on.
HELD = 100_000
#: Positions of a row; as many words of the next row follow as a phrase can reach into, then a 0.
ROW = 512
#: Positions whose pairs of states are counted together in a task.
TOGETHER = 1 << 19

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(_UPPER + _BREAKS, _UPPER.lower() + b"." * len(_BREAKS))
_BREAK = b"."


def tokens(text: bytes) -> list[bytes]:
    """Words and breaks (a full stop, which no word holds) in order; A-Z are lower-cased."""
    return text.translate(_PLAIN).replace(_BREAK, b" . ").split()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, with a break between texts."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        texts["und" if lang is None else lang].append(text or b"")
    for lang, parts in texts.items():
        yield lang, _BREAK.join(parts)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n; the row without a word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                n = sum(found.values()) - found.pop(_BREAK, 0)
                words = [None, *found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                     pa.array([n, *found.values()], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in pieces(batches, "text"):
            for lang, text in _by_language(batch):
                held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def _rows(numbers: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Rows of ROW positions, `reach` words of context and a 0; runs of zeros are one 0."""
    numbers = numbers[(numbers != 0) | np.r_[True, numbers[:-1] != 0]] if len(numbers) else numbers
    for i in range(0, len(numbers), ROW):
        yield np.append(numbers[i:i + ROW + reach], 0)


def _encoded(docs: DataFrame, shards: Iterator[dict], reach: int, shelf: Shelf) -> DataFrame:
    """ids (word numbers), stored, in one pass over the texts.

    A task numbers the distinct words of GROUP bytes of text at a time, so that it goes through the shards once for each group.
    """
    held = [docs.sparkSession.sparkContext.broadcast(shard) for shard in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(pieces(batches, "text"), GROUP if len(held) > 1 else 0):
            for numbers in _numbered(group, held):
                made = list(_rows(numbers, reach))
                if made:
                    ids = pa.ListArray.from_arrays(np.cumsum([0] + [len(m) for m in made]).astype(np.int32),
                                                   pa.array(np.concatenate(made)))
                    yield pa.RecordBatch.from_arrays([ids], ["ids"])

    made = shelf.keep(docs.select("lang", "text").mapInArrow(run, "ids array<long>"))
    for shard in held:
        shard.unpersist()
    return made


def _grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[str, dict, np.ndarray]]]:
    """Language, its distinct words so far with their places, and the places of the words of a piece, for `limit` bytes of text."""
    group: list = []
    known: dict[str, dict] = defaultdict(dict)
    n = 0
    for batch in batches:
        for lang, text in _by_language(batch):
            found, places = tokens(text), known[lang]
            group.append((lang, places, np.fromiter((places.setdefault(w, len(places)) for w in found), np.int64, len(found))))
            n += len(text)
        if n >= limit:
            yield group
            group, known, n = [], defaultdict(dict), 0
    if group:
        yield group


def _numbered(group: list[tuple[str, dict, np.ndarray]], shards: list) -> Iterator[np.ndarray]:
    """Word numbers of the pieces of a group; 0 for words of no shard."""
    known = {lang: places for lang, places, _ in group}
    numbers = {lang: np.zeros(len(places), np.int64) for lang, places in known.items()}
    for held in shards:
        for lang, places in known.items():
            get = held.value.get(lang, {}).get
            np.maximum(numbers[lang], np.fromiter((get(w, 0) for w in places), np.int64, len(places)), out=numbers[lang])
        if len(shards) > 1:
            _let_go(held)
    for lang, _, at in group:
        yield numbers[lang][at]


def double_array(parents: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base of each parent, check and edge of each slot: the edge (p, c) lies at base[p] + c, where check is p.

    `parents` ascend from 0 and `labels` are numbers from 0, a parent's labels distinct.  Parents of many edges are laid
    one over the other while a random base fits, then in a new stretch; the others take random bases, all at once, until each fits.
    """
    n, wide = int(parents[-1]) + 1, int(labels.max()) + 1
    counts = np.bincount(parents, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    base = np.zeros(n, np.int64)
    check = np.full(4 * len(parents) + 4 * wide + 64, -1, np.int32)
    edge = np.zeros(len(check), np.int32)
    order = np.argsort(-counts, kind="stable")
    many = order[counts[order] > 6]
    stripe = 0
    for p in many:
        own = labels[first[p]:first[p + 1]]
        tried = rng.integers(stripe, stripe + wide, 256)
        for part in (own[:8], own):  # most bases fail at the first labels
            tried = tried[(check[tried[:, None] + part] < 0).all(1)]
        if not len(tried):
            stripe += 2 * wide
            tried = [stripe]
            if stripe + 2 * wide > len(check):
                check = np.concatenate([check, np.full(len(check), -1, np.int32)])
                edge = np.concatenate([edge, np.zeros(len(edge), np.int32)])
        base[p] = tried[0]
        check[base[p] + own], edge[base[p] + own] = p, np.arange(first[p], first[p + 1])
    few = np.ones(n, bool)
    few[many] = False
    edges = np.flatnonzero(few[parents])
    winner = np.zeros(len(check), np.int64)
    while len(edges):
        tried = rng.integers(0, len(check) - wide, n)
        slots = tried[parents[edges]] + labels[edges]
        winner[slots] = edges
        fits = np.ones(n, bool)
        fits[parents[edges[(check[slots] >= 0) | (winner[slots] != edges)]]] = False
        on = fits[parents[edges]]
        done = edges[on]
        base[parents[done]] = tried[parents[done]]
        check[slots[on]], edge[slots[on]] = parents[done], done
        edges = edges[~on]
    return base, check, edge


class Trie:
    """A shard of the edges of one level: (node, next word) leads to the node `first` + place of the edge."""

    def __init__(self, parents: np.ndarray, words: np.ndarray, first: int):
        self.nodes, local = np.unique(parents, return_inverse=True)
        self.words, label = np.unique(words, return_inverse=True)
        self.first, self.edges = first, len(parents)
        self.base, self.check, self.edge = double_array(local, label)

    def advance(self, nodes: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The nodes that all states reach with their next words; 0 where there is no edge."""
        out = np.zeros(len(nodes), np.int64)
        live = np.flatnonzero((nodes >= self.nodes[0]) & (nodes <= self.nodes[-1]) & (following > 0))
        p = np.minimum(np.searchsorted(self.nodes, nodes[live]), len(self.nodes) - 1)
        c = np.minimum(np.searchsorted(self.words, following[live]), len(self.words) - 1)
        slot = self.base[p] + c
        hit = (self.check[slot] == p) & (self.nodes[p] == nodes[live]) & (self.words[c] == following[live])
        out[live[hit]] = self.first + self.edge[slot[hit]]
        return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and nodes of all rows in one line (each row ends in 0), offsets, and which positions are a row's own."""
    ids, nodes = batch.column("ids"), batch.column("nodes")
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    return flat, nodes.flatten().to_numpy(zero_copy_only=False), offsets, place < ROW


def _together(batches: Iterator[pa.RecordBatch], positions: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold that many positions, so that a shard is read once for all of them."""
    held: list = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("ids").flatten())
        if n >= positions:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _let_go(held) -> None:
    """Drop the worker's copy of a broadcast value; the next use reads it again from the executor's disk."""
    held.__dict__.pop("_value", None)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.append(x[by:], np.zeros(min(by, len(x)), x.dtype))


def _candidates(rows: DataFrame, size: int, least: int) -> DataFrame:
    """parent, suffix, word and n: phrases of size + 1 words whose first and last `size` words are accepted, n >= least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> Iterator[pa.RecordBatch]:
            a, b, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(a):
                return
            order = np.argsort(a << 32 | b) if max(a.max(), b.max()) < 1 << 31 else np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[at]), pa.array(b[at]), pa.array(w[at]), pa.array(np.diff(np.append(at, len(a))))],
                ["parent", "suffix", "word", "n"])

        n = 0
        for batch in batches:
            ids, nodes, _, own = _flat(batch)
            after = _shifted(nodes, 1)
            on = np.flatnonzero(own & (nodes > 0) & (after > 0))
            held.append((nodes[on], after[on], _shifted(ids, size)[on]))
            n += len(on)
            if n > TOGETHER:
                yield from out()
                n = 0
        if held:
            yield from out()

    made = rows.select("ids", "nodes").mapInArrow(run, "parent long, suffix long, word long, n long")
    return made.groupBy("parent", "suffix", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _advanced(rows: DataFrame, edges: DataFrame, n_edges: int, size: int, n_words: int, last: bool, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """ids and next (the nodes that stand for `size` words), stored, and the counts (id, f) of the accepting states.

    A pass takes AT_ONCE shards of edges: a task keeps some rows and goes through the shards, one of them in memory at a time.
    A task reports each edge once, so there are as many tasks as the cluster runs at once, or as make POSITIONS positions per edge.
    """
    first, most = 1, SHARD * AT_ONCE
    rows = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, n_words // (POSITIONS * min(n_edges, most))))
    context = rows.sparkSession.sparkContext
    counts, before = None, None
    long = "array<long>"
    for start in range(first, first + n_edges, most):
        ends = start + most >= first + n_edges
        until = min(start + most, first + n_edges)
        shards = []
        for low in range(start, until, SHARD):
            part = edges.where(F.col("id").between(low, min(low + SHARD, until) - 1)).orderBy("id").toArrow()
            shards.append(context.broadcast(Trie(part["parent"].to_numpy(), part["word"].to_numpy(), low)))
            del part
        columns = ["ids", *([] if ends else ["nodes"]), "next", "node", "n"]

        def run(batches: Iterator[pa.RecordBatch], shards=shards, ends=ends, columns=columns, start=start, n=until - start) -> Iterator[pa.RecordBatch]:
            accepted = np.zeros(n, np.int64)
            for batch in _together(batches, 2 * TOGETHER if len(shards) > 1 else 0):
                ids, nodes, offsets, own = _flat(batch)
                following = _shifted(ids, size - 1)
                reached = np.zeros(len(nodes), np.int64)
                for held in shards:
                    reached = np.maximum(reached, held.value.advance(nodes, following))
                    if len(shards) > 1:
                        _let_go(held)
                on = reached[own]
                accepted += np.bincount(on[on > 0] - start, minlength=n)
                if last and ends:
                    continue
                if "next" in batch.schema.names:
                    reached = np.maximum(reached, batch.column("next").flatten().to_numpy(zero_copy_only=False))
                none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                made = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(reached))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids"), *([] if ends else [batch.column("nodes")]), made, none, none], columns)
            at = np.flatnonzero(accepted)
            none = pa.nulls(1, pa.list_(pa.int64()))
            for i in range(0, len(at), 1 << 16):
                k = at[i:i + (1 << 16)]
                lists = [pa.ListArray.from_arrays(np.array([0, len(k)], np.int32), pa.array(x)) for x in (k + start, accepted[k])]
                yield pa.RecordBatch.from_arrays([none] * (len(columns) - 2) + lists, columns)

        made = shelf.keep(rows.mapInArrow(run, ", ".join(f"{c} {long}" for c in columns)))
        for held in shards:
            held.unpersist()
        found = made.where("node is not null").select(F.explode(F.arrays_zip("node", "n")).alias("x")).groupBy(
            F.col("x.node").alias("id")).agg(F.sum("x.n").alias("f"))
        counts = found if counts is None else counts.unionByName(found)
        if before is not None:
            counts = shelf.keep(counts)
            shelf.drop(before)
        before = made
        rows = made.where("ids is not null").drop("node", "n")
    return made, counts


def _levels(docs: DataFrame, least: int, longest: int, shelf: Shelf) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language in all (lang, n), and per level the frequent phrases.

    The first level has id, lang, text and f; the others id, parent, suffix (ids of the level before) and f.
    """
    counted = shelf.keep(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", "n")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    words = numbered(counted.where("word is not null").withColumnRenamed("n", "f"), [F.desc("f"), "lang", "word"], shelf, "id")
    n_words = words.count()
    levels = [words.select("id", "lang", F.col("word").alias("text"), "f")]

    def shards() -> Iterator[dict]:
        for start in range(1, max(n_words, 1) + 1, SHARD):
            shard: dict = defaultdict(dict)
            for r in words.where(F.col("id").between(start, start + SHARD - 1)).toLocalIterator():
                shard[r["lang"]][r["word"].encode()] = r["id"]
            yield dict(shard)

    held = _encoded(docs, shards(), longest - 1, shelf)
    rows = held.withColumn("nodes", F.col("ids"))
    for size in range(2, longest + 1):
        edges = numbered(shelf.keep(_candidates(rows, size - 1, least)), ["parent", "suffix"], shelf, "id")
        n_edges = edges.count()
        if not n_edges:
            break
        further, counts = _advanced(rows, edges, n_edges, size, all_words, size == longest, shelf)
        levels.append(shelf.keep(edges.drop("n", "word").join(counts, "id").where(F.col("f") >= least)))
        shelf.drop(held)  # only the rows of the newest level are read again
        held, rows = further, further.where("ids is not null").select("ids", F.col("next").alias("nodes"))
    return totals, levels


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language (all, if None).

    a, l and r count the phrase and the two parts of its worst cut (the earliest of equals), n all words of the language.
    """
    shelf = Shelf(docs.sparkSession)
    totals, levels = _levels(docs, least, longest, shelf)
    none = F.array().cast("array<long>")
    full, known = [], levels[0].withColumns({"heads": none, "tails": none})
    for level in levels[1:]:
        first = known.select(F.col("id").alias("parent"), "lang", "text", F.array_append("heads", F.col("f")).alias("heads"))
        rest = known.select(F.col("id").alias("suffix"), F.substring_index("text", " ", -1).alias("word"), F.array_append("tails", F.col("f")).alias("tails"))
        known = shelf.keep(level.join(first, "parent").join(rest, "suffix").select(
            "id", "parent", "suffix", "lang", F.concat_ws(" ", "text", "word").alias("text"), "f", "heads", "tails"))
        full.append(known)
    kept = None
    for size, level in enumerate(full, 2):
        cut = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda k: F.struct(
            F.expr("cast(cast(f as decimal(20,0)) * %d as decimal(38,0))" % SCALE).alias("_a"), k.alias("k"),
            F.element_at("heads", k).alias("l"), F.element_at("tails", F.lit(size) - k).alias("r")))
        scored = level.withColumn("cut", cut).withColumn("cut", F.expr(
            "array_min(transform(cut, x -> struct(cast(x._a div cast(x.l + x.r as decimal(20,0)) as long) as score, x.k as k, x.l as l, x.r as r)))"))
        if size - 1 < len(full):
            longer = full[size - 1]
            over = longer.select(F.explode(F.array("parent", "suffix")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            scored = scored.join(over, "id", "left").where(F.col("_f").isNull() | (100 * F.col("_f") < cover * F.col("f")))
        scored = scored.select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        kept = scored if kept is None else kept.unionByName(scored)
    if kept is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # a language is cut in parts first, so that no task sorts all its phrases
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_n") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return shelf.close(ranked.join(totals.withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"))
