import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from creditspark.llm import neardup as N
from creditspark.llm.common import Shelf
from test_llm_words import shingle_tuples


def brute(rows, least=0.8):
    sets, parent = {}, {}
    for d, t in rows:
        if d is not None:
            s = frozenset(shingle_tuples(t)) or frozenset([("raw", t or "")])
            sets.setdefault(d, []).append(s)
            parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, rows = text(120), []
    rows += [(i, varied(rng, base, rng.randrange(4))) for i in range(100, 160)]  # one large group of near copies
    chain = [text(200)]
    for _ in range(12):
        chain.append(varied(rng, chain[-1], 3))
    rows += [(200 + i, t) for i, t in enumerate(chain)]
    rows += [(300 + i, "Same text, copied MANY times!" if i % 2 else "same text copied many times") for i in range(30)]
    rows += [(400 + i, text(rng.randrange(1, 40))) for i in range(30)]
    rows += [(500, None), (501, ""), (502, "..."), (503, "..."), (504, "two words"), (505, "Two, words"), (506, "w " * 50_000),
             (None, "no id"), (None, None), (400, rows[-30][1]), (507, "w " * 60_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("star, block, compared", [(N.STAR, N.BLOCK, N.COMPARED), (7, 3, 500)])
def test_classes_equal_brute_force(spark, monkeypatch, star, block, compared):
    monkeypatch.setattr(N, "STAR", star)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "COMPARED", compared)
    rows = documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, label int")
    out = N.classes(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == brute(rows)
    assert {r.class_id for r in out if r.doc_id is None} == {None}
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    want = brute(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_a_bucket_of_many_classes_is_compared_in_blocks(spark, monkeypatch):
    """Nodes that all share their buckets: the screen decides, whatever the blocks."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 256, (9, N.COORDINATES))
    rows = [(int(10 * c + k), bytes(np.where(rng.random(N.COORDINATES) < 0.05, 255 - centres[c], centres[c]).astype(np.uint8)), c if k < 3 else 100 + 10 * c + k)
            for c in range(9) for k in range(6)]
    groups = spark.createDataFrame([(n, bytearray(s)) for n, s, _ in rows], "node long, sig binary")
    placed = spark.createDataFrame([(b, n, int(label)) for b in (1, 2) for n, _, label in rows], "bucket long, node long, label long")
    need = N.least_agreement(0.8)
    got = {(r.node, r.centre) for r in N._cross_pairs(placed, groups, need, Shelf(spark)).collect()}
    agree = lambda x, y: sum(p == q for p, q in zip(x, y)) >= need
    assert got == {(a, b) for a, x, p in rows for b, y, q in rows if a > b and p != q and agree(x, y)} and got


def test_texts_much_like_a_large_group_are_not_written_as_pairs(spark, monkeypatch):
    """80 texts at similarities below 0.8 to 240 near copies: no table has a row for each of the 19,200 pairs."""
    rng, words, rows = random.Random(11), [f"b{i}" for i in range(300)], []
    for i in range(240):
        rows.append((i, varied(rng, " ".join(words), 1)))
    for i in range(240, 320):
        at = rng.randrange(5, 260)
        rows.append((i, " ".join(words[:at] + [f"f{rng.randrange(10**6)}" for _ in range(30)] + words[at + 30:])))
    written, keep = [], Shelf.keep
    monkeypatch.setattr(Shelf, "keep", lambda self, df: (written.append(keep(self, df)), written[-1])[1])
    monkeypatch.setattr(Shelf, "drop", lambda self, *tables: None)
    out = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = [t.count() for t in written]
    assert {r.doc_id: r.class_id for r in out} == brute(rows) == {i: 0 if i < 240 else i for i in range(320)}
    assert max(counts) <= len(rows) * N.BANDS


@pytest.mark.parametrize("load", [1, 300])
def test_blocks_of_heavy_texts_are_judged_in_parts(spark, monkeypatch, load):
    monkeypatch.setattr(N, "STAR", 7)
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "LOAD", load)
    rows = [(None if d is None else f"d{d}", t) for d, t in documents()]
    out = N.classes(spark.createDataFrame(rows + rows[:20], "doc_id string, text string")).collect()
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == brute(rows)


@pytest.mark.parametrize("load", [1 << 20, 40])
def test_links_of_a_block_join_what_all_its_links_join(spark, monkeypatch, load):
    """Two sides of one block and a block with itself, weights by occurrences."""
    monkeypatch.setattr(N, "LOAD", load)
    rng, texts = random.Random(8), {}
    for c in range(6):
        base = " ".join(f"c{c}w{rng.randrange(2)}" for _ in range(60))
        texts |= {10 * c + k: varied(rng, base, k % 4) for k in range(8)}
    ids = sorted(texts)
    places = [(1, 1, 0, 0, n, n, 56, True, True) for n in ids] + [(2, 0, 0, 1, n % 10, n, 56, n % 2 == 0, n % 2 == 1) for n in ids]
    got = N._cross_links(
        spark.createDataFrame(places, "bucket long, k int, i long, j long, label long, node long, size long, left boolean, right boolean"),
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 0.6, "count").collect()
    bags = {n: Counter(tuple(t.split()[i:i + 5]) for i in range(56)) for n, t in texts.items()}
    assert max(bags[0].values()) > 1
    alike = lambda a, b: (bags[a] & bags[b]).total() >= 0.6 * (bags[a] | bags[b]).total()
    want = [(a, b) for a in ids for b in ids if a < b and alike(a, b)]

    def joined(pairs):
        label = {n: n for n in ids}
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = {n: low if v == high else v for n, v in label.items()}
        return label

    assert want and joined(want) == joined([(r.node, r.centre) for r in got])
    assert all(alike(r.node, r.centre) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(df).collect() == [] and N.keep_one(df).collect() == []


def test_signatures_agree_as_often_as_weights_do():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    x[:60] = y[60:100] = 0
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    sig = N.signatures([(names[x > 0], x[x > 0]), (names[y > 0], y[y > 0])], 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035
    one = N.signatures([(names[:1], np.ones(1))], 150)
    assert (one != 0).all() and np.array_equal(one, N.signatures([(names[:1], np.ones(1)), (names, x + 1)], 150)[:1])


def test_signatures_of_many_short_texts_hold_few_darts_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in rng.integers(20, 60, 600)]
    sets = [(names, rng.integers(1, 4, len(names)).astype(float)) for names, _ in sets]
    tracemalloc.start()
    sig = N.signatures(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6  # all darts of the texts together are some 1.2 million, of 24 bytes and more each
    monkeypatch.setattr(N, "DARTS", 1)
    assert np.array_equal(sig[:20], N.signatures(sets[:20]))
    monkeypatch.setattr(N, "DARTS", 1 << 40)
    assert np.array_equal(sig, N.signatures(sets))


def test_darts_of_equal_rank_go_to_the_smaller_name_whenever_they_come():
    darts = [(0, 0.5, 7), (0, 0.5, 3), (0, 0.25, 9), (0, 0.25, 5), (0, 0.75, 1), (0, 0.25, 11)]
    parts = [(np.array([o]), np.array([r]), np.array([d], np.uint64)) for o, r, d in darts]
    for size in (1, 2, 3, 6):
        rank, out = np.full((1, 1), np.inf), np.full((1, 1), 2**64 - 1, np.uint64)
        for i in range(0, len(parts), size):
            N._earliest(parts[i:i + size], rank, out)
        assert rank[0, 0] == 0.25 and out[0, 0] == 5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "node long, centre long")
    labels = {r.node: r.label for r in N.components(links, Shelf(spark)).collect()}
    assert labels == {**{i: 0 for i in range(1, 61)}, 101: 100}
