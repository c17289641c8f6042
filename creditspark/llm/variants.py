"""Spelling variants by a relational trie frontier.

Words are the runs of letters of the texts; one in DELETE_EVERY runs of a document, chosen by a checksum, stands for a
misspelling and loses a letter.  Words that differ by one letter more, less or other are near.

An edit leaves one half of a word as it is.  So there are two tries, one of the words and one of the words reversed: in the
first, a word is followed unchanged over its first half, in the second over its last half, and the edit comes after it.
A node is its prefix with a mark of the direction; the edge table has (node, letter, words below), and the rest of the word where
only one is left below (path compression).  The frontier holds states (word, position, node, edits).  Level by level it is joined
with the edge table: an unedited state goes on to its own letter, to all larger letters (replaced; the other word of the pair finds
the smaller ones) or skips its letter (deleted; an inserted letter is a deleted one of the longer word), an edited state goes on to its own
letter only.  States that reach the end of a word with one edit are neighbours.  A node below which only one word is left needs no further
level, so there are as many levels as words share letters, LONG / 2 at most.

Words of LONG letters or more would need as many levels as letters.  They are joined by the hashes of all their forms with one
letter left out or blank, which is linear in their length, and verified; the results are the same.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the checksum; repeated rows count as
often as they stand there; of forms with equal counts the smallest in code-point order is taken; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.common import Shelf, numbered
from creditspark.llm.words import mix

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form occurs this many times as often as the word.
RATIO = 10
DELETE_EVERY = 31
#: Letters from which on a word is not followed through the tries.
LONG = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n, its number of occurrences in all documents."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS), F.lit(0))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run")
    h, size = F.crc32(key.cast("binary")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select(
        F.when(h % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _letter(text: Column, at: Column) -> Column:
    """The letter at a place from 0; empty behind the end."""
    return F.substring(text, at + 1, F.lit(1))


def _rest(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def _marked(words: DataFrame) -> DataFrame:
    """t, the word with a mark of its direction, and half, the place in t from which on it may be edited."""
    half = F.floor(F.length("word") / 2).cast("int")
    return words.select(F.explode(F.array(
        F.struct(F.concat(F.lit(">"), "word").alias("t"), (half + 1).alias("half")),
        F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("t"), (F.length("word") - half + 1).alias("half")),
    )).alias("x")).select("x.t", "x.half")


def _edges(marked: DataFrame, shelf: Shelf) -> DataFrame:
    """node, letter, below (words), tail (the rest of the only word) and ends (a word ends here), of nodes with several words.

    Partners of a word are not longer than it, so a word's nodes before its own half are not visited.
    """
    at = F.col("at")
    paths = marked.select("t", F.explode(F.sequence("half", F.length("t") - 1)).alias("at")).select(
        F.substring("t", F.lit(1), at).alias("node"), _letter(F.col("t"), at).alias("letter"), _rest(F.col("t"), at + 1).alias("rest"))
    edges = paths.groupBy("node", "letter").agg(
        F.count(F.lit(1)).alias("below"), F.max("rest").alias("tail"), F.max(F.col("rest") == "").alias("ends"))
    edges = shelf.keep(edges.select("node", "letter", "below", F.when(F.col("below") == 1, F.col("tail")).alias("tail"), "ends"))
    shared = edges.groupBy("node").agg(F.sum("below").alias("_n")).where("_n > 1").select(F.col("node").alias("_node")).unionByName(
        edges.where("below > 1 and ends").select(F.concat("node", "letter").alias("_node")))  # one word ends at the node
    return shelf.keep(edges.join(shared, F.col("node") == F.col("_node"), "left_semi"))


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on; `found` marks those that stand for a neighbour, whose word is the node."""
    t, at = F.col("t"), F.col("at")
    # a letter of a run of equal ones is left out at the end of the run only
    skip = (F.col("edits") == 0) & (_letter(t, at) != _letter(t, at + 1))
    gone = at + 1 == F.length(t)
    ended = states.where(skip & gone & F.col("ends")).select("t", (at + 1).alias("at"), "node", F.lit(1).alias("edits"), "ends", F.lit(True).alias("found"))
    skipped = states.where(skip & ~gone).select("t", (at + 1).alias("at"), "node", F.lit(1).alias("edits"), F.lit(False).alias("ends"))
    both = states.unionByName(skipped).withColumn("_own", _letter(t, at)).withColumnRenamed("ends", "_ends")
    to = edges.withColumnRenamed("node", "_node")
    met = both.join(to, (F.col("node") == F.col("_node")) & (
        (F.col("letter") == F.col("_own")) & ((F.col("edits") == 1) | (F.col("below") > 1))
        | (F.col("edits") == 0) & (F.col("letter") > F.col("_own"))))
    edits = F.when(F.col("letter") == F.col("_own"), F.col("edits")).otherwise(1)
    rest = _rest(t, at + 1)
    path = F.concat("node", "letter")
    tailed = F.col("tail").isNotNull()
    moved = met.withColumn("edits", edits).select(
        "t", (at + 1).alias("at"), F.when(tailed, F.concat(path, "tail")).otherwise(path).alias("node"), "edits", "ends",
        ((F.col("edits") == 1) & F.when(tailed, F.col("tail") == rest).otherwise((rest == "") & F.col("ends"))).alias("found"),
        (~tailed & (rest != "")).alias("_open"))
    return moved.where("found or _open").drop("_open").unionByName(ended)


def _trie_pairs(words: DataFrame, shelf: Shelf) -> DataFrame:
    """a and b, near words of at most LONG letters, each pair once."""
    marked = shelf.keep(_marked(words.where(F.length("word") <= LONG)))
    edges = _edges(marked, shelf)
    nodes = edges.select(F.col("node").alias("_node")).distinct()
    states = marked.select("t", F.col("half").alias("at"), F.substring("t", F.lit(1), F.col("half")).alias("node"),
                           F.lit(0).alias("edits"), F.lit(False).alias("ends"))
    states = states.join(nodes, F.col("node") == F.col("_node"), "left_semi")
    pairs, before = None, None
    while pairs is None or not states.isEmpty():  # LONG / 2 + 1 levels at most
        moved = shelf.keep(_level(states, edges))
        found = shelf.keep(moved.where("found").select("t", "node"))
        pairs = found if pairs is None else pairs.unionByName(found)
        states = moved.where("not found").drop("found")
        if before is not None:
            shelf.drop(before)
        before = moved

    def plain(name: str) -> Column:
        word = _rest(F.col(name), F.lit(1))
        return F.when(F.substring(name, 1, 1) == ">", word).otherwise(F.reverse(word))

    return pairs.select(plain("t").alias("a"), plain("node").alias("b")).distinct()


def _names(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a word, of it with each letter left out, and of it with each letter blank."""
    n = len(codes)
    up = np.full(n + 1, np.uint64(base), np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n], out=sums[1:])
    back = np.uint64(pow(base, -1, 1 << 64))
    blank = sums[n] - (codes + np.uint64(1)) * up[:n]
    without = sums[:n] + (sums[n] - sums[1:]) * back
    return mix(sums[n:] + np.uint64(n)), mix(without + np.uint64(n - 1)), mix(blank ^ np.uint64(0x5555) + np.arange(n, dtype=np.uint64))


def _long_pairs(words: DataFrame, shelf: Shelf) -> DataFrame:
    """a and b, near words of LONG letters or more, each pair once."""
    rows = numbered(words.where(F.length("word") >= LONG).select("word"), ["word"], shelf, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                kinds = [np.full(1, -1), np.arange(len(codes)), np.arange(len(codes))]
                hashes = [_names(codes, b) for b in _BASES]
                for kind, (at, x, y) in enumerate(zip(kinds, *hashes)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(at), kind, np.int32)),
                         pa.array(at.astype(np.int64)), pa.array(np.full(len(at), i, np.int64))], ["x", "y", "kind", "at", "id"])

    forms = shelf.keep(rows.mapInArrow(run, "x long, y long, kind int, at long, id long"))
    a, b = forms.alias("a"), forms.alias("b")
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    other = a.where("kind = 2").join(b.where("kind = 2"), same & (F.col("a.at") == F.col("b.at")) & (F.col("a.id") < F.col("b.id")))
    fewer = a.where("kind = 1").join(b.where("kind = 0"), same)
    ends = [F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.kind").alias("kind"), F.col("a.at").cast("int").alias("at")]
    met = other.select(*ends).unionByName(fewer.select(*ends))
    texts = met.join(rows.select(F.col("id").alias("i"), F.col("word").alias("a")), "i").join(
        rows.select(F.col("id").alias("j"), F.col("word").alias("b")), "j")
    at = F.col("at")
    equal = (F.substring("a", F.lit(1), at) == F.substring("b", F.lit(1), at)) & (
        _rest(F.col("a"), at + 1) == _rest(F.col("b"), F.when(F.col("kind") == 2, at + 1).otherwise(at)))
    sizes = F.length("a") - F.length("b") == F.when(F.col("kind") == 2, 0).otherwise(1)
    return texts.where(equal & sizes).select("a", "b").distinct()


def _roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """word and root, the last of the forms from the word on: each turn doubles the steps."""
    steps = shelf.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        if steps.join(on, F.col("root") == F.col("_w"), "left_semi").isEmpty():
            return steps
        further = shelf.keep(steps.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")))
        shelf.drop(steps)
        steps = further


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words."""
    shelf = Shelf(docs.sparkSession)
    words = shelf.keep(word_counts(docs))
    pairs = shelf.keep(_trie_pairs(words, shelf).unionByName(_long_pairs(words, shelf)).distinct())
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = links.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("_a")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    near = words.join(known, F.col("word") == F.col("_a"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.n") >= ratio * F.col("n"), F.struct(F.col("best.b").alias("form"), (-F.col("best.n")).alias("n"))).alias("best"))
    near = shelf.keep(near.select("word", F.col("best.form").alias("form"), "n", "n_near", F.col("best.n").alias("form_n")))
    roots = _roots(near.where("form is not null"), shelf).select(F.col("word").alias("_w"), "root")
    return shelf.close(near.join(roots, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
