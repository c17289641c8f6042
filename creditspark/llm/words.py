"""Words and shingles of five words as 64-bit names, computed over whole buffers of text.

A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text.
A shingle is five words in a row.  A text of one to four words has one shingle, all its
words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from creditspark.llm.common import text_buffer

SIZE = 5
#: Bytes of text whose words are named at once, at some 40 bytes of memory for each.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
_IS_WORD[128:] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        made = []
        for base in (BASE, inverse):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def range_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bytes data[start:end] for each pair: equal bytes, equal name."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words in order, and the n + 1 offsets of the texts among them."""
    inside = _IS_WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    names = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # segments bound the memory whatever the length of the texts
        low = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = ends[upto - 1]
        names[done:upto] = range_names(data[low:high], starts[done:upto] - low, ends[done:upto] - low)
        done = upto
    return names, np.searchsorted(starts, offsets)


def shingles(names: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles in order, repeats kept, and the offsets of the texts among them."""
    counts = np.diff(bounds)
    if len(names) >= size:
        n = len(names) - size + 1
        made = np.zeros(n, np.uint64)
        for j in range(size):
            made *= BASE
            made += names[j:j + n]
        owner = np.repeat(np.arange(len(counts)), counts)
        whole = owner[:n] == owner[size - 1:]
        made, owner = mix(made[whole]), owner[:n][whole]
    else:
        made, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for at, i in enumerate(short):
            value = int(counts[i])
            for w in names[bounds[i]:bounds[i + 1]]:
                value = (value * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF
            extra[at] = value
        made, owner = np.concatenate([made, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        made, owner = made[order], owner[order]
    return made, np.searchsorted(owner, np.arange(len(counts) + 1))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text."""
    made, bounds = shingles(*words(*lowered(column)))
    return [np.unique(made[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
