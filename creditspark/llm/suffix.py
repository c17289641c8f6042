"""Removal of repeated strings of LENGTH bytes by distributed prefix doubling over content-chosen positions.

A string of 100 bytes goes if it also starts earlier.  Sorting all positions of a corpus at growing offsets would shuffle
every byte's position several times, some sixty times the input.  So positions are ranked only where
repeats can begin to differ:

* Anchors.  The anchor of a 100-byte string is its GRAM-byte piece with the smallest name.  It depends on the string
  alone, so equal strings have equal anchors at equal offsets, and a repeated string has a repeated anchor.
  Consecutive strings share anchors; the stretch of an anchor spans all of them.
* Round 1, rank by GRAM bytes, then by the whole stretch: Spark sorts (name of the piece, name of the stretch, document,
  place).  A piece that occurs once is unique, and so are all strings around it: it is dropped.  Of equal
  stretches all but the first are repeats, whole.  What is left are first stretches whose piece also stands in other
  stretches: the ends of repeated passages.
* Round 2, rank by 100 bytes: only the strings of those stretches are compared one by one.

Skew.  Of equal stretches a task sends only those that come before all it has sent, so a stretch that stands in a third of
all rows meets as one row per task.  A piece with OFTEN different stretches within PART bytes is spread over many tasks by its
stretches; one row tells the piece's own task, and all its strings are then compared by a further
aggregation instead of side by side.  Any choice of the pieces to spread gives the same result.
Names are 64-bit and count only together with the piece's.  Texts are compressed before they are joined with their repeats.

Defined cases: a null text counts as empty; texts shorter than LENGTH bytes lose nothing; a null doc_id
comes before all others; rows that share a doc_id are documents of their own, in order of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm import words as W
from creditspark.llm.common import pieces, stored, text_buffer

LENGTH = 100
GRAM = 40
#: Bytes of text whose positions are ranked at once inside a task.
PART = 1 << 20
OFTEN, SPREAD = 6, 256
#: Stretches that a task remembers at most, 24 bytes each; beyond, it forgets and sends more.
REMEMBERED = 2_000_000
_U = np.uint64
_TOLD = np.iinfo(np.int64).min


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int | None = None):
    """The anchors of all strings of `length` bytes inside one text each.

    Returns arrays: text number, first start, number of starts, name of the gram, name of the stretch.
    """
    gram = gram or gram_of(length)
    span = length - gram + 1
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = W.powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    grams = W.mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
    bits = np.uint64(max(int(n).bit_length(), 1))
    low = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:n - length + 1], low[span - width:span - width + n - length + 1])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(owner[:n - length + 1] == owner[length - 1:])
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = place[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    lo, at = start[first], at[first]
    hi = lo + count + length - 1
    names = (prefix[hi] - prefix[lo]) * down[lo]
    names = W.mix(names ^ W.mix((at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)))
    text = owner[lo]
    return text, lo - offsets[text], count, grams[at], names


def _names_of_strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return W.range_names(data, starts, starts + length)


class _Seen:
    """The names a task has sent, each with its earliest place; sorted parts keep look-ups vectorised."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def earliest(self, names: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each name whether its place is earlier than all places of the name so far (and is kept as such)."""
        order = np.lexsort((at, doc, names))
        n = names[order]
        first = np.ones(len(n), bool)
        first[1:] = n[1:] != n[:-1]
        own = order[first]
        n, d, a = names[own], doc[own], at[own]
        new = np.ones(len(n), bool)
        for names_, doc_, at_ in self.parts:
            i = np.minimum(np.searchsorted(names_, n), len(names_) - 1)
            new &= (names_[i] != n) | (d < doc_[i]) | ((d == doc_[i]) & (a < at_[i]))
        out = np.zeros(len(names), bool)
        out[own[new]] = True
        if sum(len(p[0]) for p in self.parts) > REMEMBERED:
            self.parts.clear()
        if new.any():
            self.parts.append((n[new], d[new], a[new]))
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
            n, d, a = (np.concatenate(x) for x in zip(self.parts.pop(), self.parts.pop()))
            order = np.lexsort((a, d, n))
            n, d, a = n[order], d[order], a[order]
            first = np.ones(len(n), bool)
            first[1:] = n[1:] != n[:-1]
            self.parts.append((n[first], d[first], a[first]))
        return out


def _numbers(ids: pa.Array) -> np.ndarray:
    """Document ids in their order; a null comes first."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def gram_of(length: int) -> int:
    return max(length - 200, min(GRAM, length * 2 // 5), 1)


def _segments(b: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """Bytes, offsets, row and place of each text, and the rows: a long text comes in overlapping parts."""
    for part in pieces(iter([b]), "text", PART):
        data, offsets = text_buffer(part.column("text"))
        base = np.arange(part.num_rows)
        if len(data) <= 2 * PART:
            yield data, offsets, base, np.zeros(part.num_rows, np.int64), part
            continue
        for i in base:  # one row of more than PART bytes
            for start in range(0, max(int(offsets[i + 1] - offsets[i]) - length + 1, 1), PART):
                end = min(int(offsets[i]) + start + PART + length - 1, int(offsets[i + 1]))
                piece = data[int(offsets[i]) + start:end]
                yield piece, np.array([0, len(piece)]), np.array([i]), np.array([start]), part


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """piece, stretch, doc_id and at: copy, place and number of strings in one number.

    at is negative for a stretch that the task has sent with an earlier place: a repeat, which passes through any
    task.  at is 0 in the row that tells a piece's own task that the piece was spread.  Names of spread pieces are odd.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            for data, offsets, rows, places, part in _segments(b, length):
                text, lo, count, piece, stretch = anchors(data, offsets, length)
                if not len(text):
                    continue
                row = rows[text]
                copy = part.column("copy").to_numpy(zero_copy_only=False)[row].astype(np.int64)
                at = (copy << 40) | ((lo + places[text]) << 8) | count
                new = seen.earliest(W.mix(piece + stretch * W.BASE), _numbers(part.column("doc_id"))[row], at)
                piece = piece & ~_U(1)
                own, which, times = np.unique(piece[new], return_inverse=True, return_counts=True)
                spread = np.zeros(len(piece), bool)
                spread[new] = times[which] >= OFTEN
                home = own[times >= OFTEN]
                piece = np.where(spread, W.mix(piece + (stretch % _U(SPREAD) + _U(1)) * W.BASE) | _U(1), piece)
                piece = np.where(new, piece, W.mix(at.view(np.uint64) + piece) & ~_U(1))
                ids = part.column("doc_id").take(pa.array(np.concatenate([row, np.full(len(home), row[0])])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([piece, home]).view(np.int64)),
                     pa.array(np.concatenate([stretch.view(np.int64), np.full(len(home), _TOLD)])), ids,
                     pa.array(np.concatenate([np.where(new, at, -at), np.zeros(len(home), np.int64)]))],
                    ["piece", "stretch", "doc_id", "at"])

    return docs.select("doc_id", "copy", "text").mapInArrow(run, f"piece long, stretch long, doc_id {kind}, at long")


def _marked(sorted_rows: DataFrame, kind_of_id: str) -> DataFrame:
    """doc_id, at, mark and piece of rows sorted by piece, stretch, document and place.

    Marks: 1 a repeat of an earlier stretch, 2 a first stretch whose piece has other stretches too, 3 the same for a
    spread piece, whose other stretches may be in other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_piece = last_stretch = None
        told = False  # whether the last piece is spread
        waiting = None  # the only stretch of the last piece so far
        names = ["doc_id", "at", "mark", "piece"]
        for b in batches:
            if not b.num_rows:
                continue
            piece, stretch, at = (b.column(c).to_numpy() for c in ("piece", "stretch", "at"))
            new_piece = np.ones(len(piece), bool)
            new_piece[1:] = piece[1:] != piece[:-1]
            new_piece[0] = last_piece is None or piece[0] != last_piece
            fresh = new_piece.copy()
            fresh[1:] |= stretch[1:] != stretch[:-1]
            fresh[0] |= last_stretch is None or stretch[0] != last_stretch
            group = np.cumsum(new_piece) - int(new_piece[0])  # group 0 may go on from the batch before
            firsts = np.bincount(group, weights=fresh & (at > 0), minlength=group[-1] + 1)
            telling = np.bincount(group, weights=at == 0, minlength=group[-1] + 1) > 0
            if not new_piece[0]:
                firsts[0] += waiting is not None or not told
                telling[0] |= told
                if waiting is not None and firsts[0] > 1:
                    yield pa.RecordBatch.from_arrays(waiting, names)
                    waiting = None
            spread = telling[group] | (piece & 1).astype(bool)
            mark = np.where(fresh, np.where(spread, 3, np.where(firsts[group] > 1, 2, 0)), 1)
            mark[at < 0] = 1
            mark[at == 0] = 0
            if new_piece[0] or group[-1] > 0:
                waiting = None
            alone = np.flatnonzero((mark == 0) & (at > 0) & (group == group[-1]))
            if len(alone):
                i = int(alone[0])
                waiting = [b.column("doc_id").slice(i, 1), pa.array([int(at[i])]), pa.array([2], pa.int32()), pa.array([int(piece[i])])]
            told = bool(telling[-1])
            last_piece, last_stretch = piece[-1], stretch[-1]
            on = np.flatnonzero(mark)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(on)), pa.array(np.abs(at[on])), pa.array(mark[on].astype(np.int32)),
                 pa.array(piece[on])], names)

    return sorted_rows.mapInArrow(run, f"doc_id {kind_of_id}, at long, mark int, piece long")


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copy, place and number of strings."""
    return at >> 40, (at >> 8) & 0xFFFFFFFF, at & 0xFF


def _by_document(marks: DataFrame, name: str) -> DataFrame:
    return marks.groupBy(F.col("doc_id").alias("_id"), F.shiftright("at", 40).cast("int").alias("_copy")).agg(
        F.collect_list(name).alias("marks"))  # at most one per byte of the document


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, copy and the compressed text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, "text"):
            packed = [squeeze.compress((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(packed, pa.binary())],
                                             ["doc_id", "copy", "packed"])

    return docs.select("doc_id", "copy", "text").mapInArrow(run, f"doc_id {kind}, copy int, packed binary")


def _with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return _packed(docs).join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), how)


def _ends(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """piece, doc_id, at, mark and the bytes of the stretches marked 2 or 3."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = _by_document(marks.where("mark > 1").withColumn("m", F.struct("at", "piece", "mark")), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                m, row, cut = part.column("marks").flatten(), [], []
                for i, marks in enumerate(part.column("marks")):
                    raw = open_.decompress(part.column("packed")[i].as_py())
                    _, lo, count = _unpacked(marks.values.field("at").to_numpy())
                    row += [i] * len(lo)
                    cut += [raw[p:p + n + length - 1] for p, n in zip(lo, count)]
                yield pa.RecordBatch.from_arrays(
                    [m.field("piece"), part.column("doc_id").take(pa.array(row)), m.field("at"), m.field("mark"),
                     pa.array(cut, pa.binary())], ["piece", "doc_id", "at", "mark", "bytes"])

    return _with_marks(docs, wanted, "inner").select("doc_id", "packed", "marks").mapInArrow(
        run, f"piece long, doc_id {kind}, at long, mark int, bytes binary")


def _strings(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row's stretch and name of every string of the stretches of a batch."""
    raw = b.column("bytes").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    _, _, count = _unpacked(b.column("at").to_numpy())
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, step, _names_of_strings(data, offsets[row] + step, length)


def _runs(doc_ids: pa.Array, at: np.ndarray, row: np.ndarray, step: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """doc_id and at of the runs of repeated strings, given in order of row and step."""
    row, step = row[repeated], step[repeated]
    copy, lo, _ = _unpacked(at)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    r = row[first]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(r)), pa.array((copy[r] << 40) | ((lo[r] + step[first]) << 8) | count)], ["doc_id", "at"])


def _compared(ends: DataFrame, length: int) -> DataFrame:
    """doc_id and at of repeated strings in stretches marked 2: all of a piece stand together, in order."""
    kind = ends.schema["doc_id"].dataType.simpleString()
    rows = ends.where("mark = 2").select("piece", "doc_id", "at", "bytes")
    rows = rows.repartition("piece").sortWithinPartitions("piece", "doc_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_seen = np.empty(0, np.uint64)  # of the last piece, which may go on in the next slice
        held_piece = None

        def compare(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal names_seen, held_piece
            piece = b.column("piece").to_numpy()
            row, step, names = _strings(b, length)
            names = W.mix(names ^ W.mix(piece[row].view(np.uint64)))
            if held_piece is not None and piece[0] != held_piece:
                names_seen = np.empty(0, np.uint64)
            first = np.zeros(len(names), bool)
            first[np.unique(names, return_index=True)[1]] = True
            repeated = ~first | np.isin(names, names_seen)
            tail = names[piece[row] == piece[-1]]
            names_seen = np.union1d(names_seen, tail) if piece[0] == piece[-1] else np.unique(tail)
            held_piece = piece[-1]
            return _runs(b.column("doc_id"), b.column("at").to_numpy(), row, step, repeated)

        for b in batches:
            for start in range(0, b.num_rows, 4096):
                yield compare(b.slice(start, 4096))

    return rows.mapInArrow(run, f"doc_id {kind}, at long")


def _compared_apart(ends: DataFrame, length: int) -> DataFrame:
    """The same for stretches marked 3: their strings are put together by name.

    A string that its task has met with an earlier place is a repeat at once; of each name a task sends its earliest strings only.
    """
    kind = ends.schema["doc_id"].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                b = batch.slice(start, 4096)
                row, step, names = _strings(b, length)
                copy, lo, _ = _unpacked(b.column("at").to_numpy())
                at = (copy[row] << 40) | ((lo[row] + step) << 8) | 1
                new = seen.earliest(names, _numbers(b.column("doc_id"))[row], at)
                runs = _runs(b.column("doc_id"), b.column("at").to_numpy(), row, step, ~new)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(runs.num_rows, pa.int64()), runs.column("doc_id"), runs.column("at")], ["name", "doc_id", "at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[new].view(np.int64)), b.column("doc_id").take(pa.array(row[new])), pa.array(at[new])],
                    ["name", "doc_id", "at"])

    strings = stored(ends.where("mark = 3").mapInArrow(expand, f"name long, doc_id {kind}, at long"))
    first = strings.where("name is not null").groupBy("name").agg(
        F.min(F.struct("doc_id", "at")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("name", "f"))
    both = strings.join(first.hint("merge"), "name").where(~F.struct("doc_id", "at").eqNullSafe(F.col("f")))
    return both.select("doc_id", "at").unionByName(strings.where("name is null").select("doc_id", "at"))


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with copy, 0 except among rows that share a doc_id."""
    docs = docs.select("doc_id", "text")
    twice = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_d")))
    if twice.isEmpty():
        return docs.withColumn("copy", F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    rows = docs.join(twice, same, "left_semi").withColumn(
        "copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1)
    return docs.join(twice, same, "left_anti").withColumn("copy", F.lit(0)).unionByName(rows)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and at: the repeated strings of every document of `_numbered`, as runs of starts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _stretches(docs, length).repartition("piece")
    marks = stored(_marked(rows.sortWithinPartitions("piece", "stretch", "doc_id", F.abs("at")), kind))
    ends = stored(_ends(docs, marks, length))
    return marks.where("mark = 1").select("doc_id", "at").unionByName(_compared(ends, length)).unionByName(
        _compared_apart(ends, length))


def _merged(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the runs of strings cover."""
    _, lo, count = _unpacked(np.sort(at))
    end = np.maximum.accumulate(lo + count + length - 1)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep`, kept (the remaining bytes) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = _numbered(docs)
    marks = _by_document(repeats(docs, length), "at")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, at in zip(b.column("packed"), b.column("marks")):
                raw = open_.decompress(packed.as_py())
                starts, ends = _merged(at.values.to_numpy(), length) if at.is_valid else ((), ())
                kept, last = [], 0
                for s, e in zip(starts, ends):
                    kept.append(raw[last:s])
                    last = e
                kept = b"".join([*kept, raw[last:]])
                rows.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *([kept] if keep else [])))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]),
                 *(pa.array(c, pa.binary()) for c in columns[4:])], names)

    return _with_marks(docs, marks, "left").select("doc_id", "packed", "marks").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else ""))
