"""Phrase collocations: equal to a count of all phrases, in shards of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from creditspark.llm import phrases as P

DOCS = "doc_id long, text string, lang string, score int, id int"


def brute(rows, least, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in found.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def rows_of(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "SAT", "on", "a", "mat", "Ärger", "ärger", "x\xa0y", "ok", "zz"]
    weights = [9, 5, 4, 4, 5, 6, 3, 2, 2, 2, 1, 1]
    ends = [" ", " ", " ", "\t", ". ", ", ", "\n", " : ", "?!"]
    return [(i, "".join(w + rng.choice(ends) for w in rng.choices(words, weights, k=rng.randint(0, 60))),
             rng.choice(["en", "fr", None]), 1, 2) for i in range(n)]


@pytest.mark.parametrize("shard, row, together, held", [(P.SHARD, P.ROW, P.TOGETHER, P.HELD), (4, 5, 7, 3)])
def test_equals_a_count_of_all_phrases(spark, monkeypatch, shard, row, together, held):
    for name, value in (("SHARD", shard), ("ROW", row), ("TOGETHER", together), ("HELD", held)):
        monkeypatch.setattr(P, name, value)
    rows = rows_of(60) + [(7, None, "en", 1, 2), (8, "", None, 1, 2), (9, " \t\n", "de", 1, 2), (None, "the cat sat " * 40, "und", 1, 2)]
    rows += rows[:5]  # repeated rows count again
    got = P.phrases(spark.createDataFrame(rows, DOCS).repartition(3), least=6)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert {tuple(r) for r in got.collect()} == brute(rows, 6, 4, 80, 2000)


def test_a_pass_takes_several_shards(spark, monkeypatch):
    """The rows are not read and written again for every shard of the trie."""
    monkeypatch.setattr(P, "SHARD", 4)
    rows, passes = rows_of(60), {}

    def through(at_once):
        monkeypatch.setattr(P, "AT_ONCE", at_once)
        written, keep = [], P.Shelf.keep
        monkeypatch.setattr(P.Shelf, "keep", lambda self, df: (written.append(df.columns), keep(self, df))[1])
        got = {tuple(r) for r in P.phrases(spark.createDataFrame(rows, DOCS).repartition(3), least=6).collect()}
        monkeypatch.setattr(P.Shelf, "keep", keep)
        passes[at_once] = sum("next" in c for c in written)
        assert sum(c == ["ids"] for c in written) == 1  # nor the texts for every shard of the dictionary
        return got

    assert through(1) == through(3) == through(100) == brute(rows, 6, 4, 80, 2000)
    assert passes[1] > passes[3] > passes[100] and passes[100] <= 3  # one for each phrase length


def test_top_cover_and_ties(spark):
    rows = [(1, "a b. " * 7 + "c d. " * 7 + "e f g. " * 9 + "f g. ", "en", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for cover, top in ((80, 2000), (95, 2000), (80, 2)):
        got = {tuple(r) for r in P.phrases(docs, least=5, cover=cover, top=top).collect()}
        assert got == brute(rows, 5, 4, cover, top)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.phrases(empty).count() == 0
    assert P.phrases(spark.createDataFrame([(1, "one two three", "en", 0, 0)], DOCS)).count() == 0
    assert P.phrases(spark.createDataFrame([(1, "one. " * 50, "en", 0, 0)], DOCS)).count() == 0


def test_a_very_long_text(spark):
    rows = [(1, "one two three four five " * 60_000, "en", 0, 0)]
    got = P.phrases(spark.createDataFrame(rows, DOCS), least=30)
    assert {tuple(r) for r in got.collect()} == brute(rows, 30, 4, 80, 2000)


def test_double_array_holds_every_edge_and_no_other():
    rng = np.random.default_rng(0)
    edges = sorted({(int(p), int(c)) for p, c in zip(rng.zipf(1.3, 4000) % 300, rng.integers(0, 500, 4000))})
    parents = np.unique(np.array([p for p, _ in edges]), return_inverse=True)[1]
    labels = np.array([c for _, c in edges])
    base, check, edge = P.double_array(parents, labels)
    slots = base[parents] + labels
    assert (check[slots] == parents).all() and (edge[slots] == np.arange(len(edges))).all()
    assert (check >= 0).sum() == len(edges)
