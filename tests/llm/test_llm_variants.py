"""Spelling variants: equal to a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from creditspark.llm import variants as V

DOCS = "doc_id long, text string, word string, n int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    out, form = {}, {}
    for w, c in n.items():
        close = [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None
        out[w] = [c, len(close)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], n[form[w]] if form[w] else None)
    return set(out.values())


def misspelt(rng, word):
    i, c = rng.randrange(len(word) + 1), rng.choice("abcéÿ")
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


@pytest.mark.parametrize("long", [64, 9])
def test_equals_a_comparison_of_all_words(spark, monkeypatch, long):
    monkeypatch.setattr(V, "LONG", long)
    rng = random.Random(4)
    words = ["abcabcab", "aaaaaaaa", "bananana", "Überraschung", "ÉCOLIERS", "éÉÿÀabcd", "cabbages", "abababababab"]
    words += ["".join(rng.choices("abc", k=rng.randint(7, 9))) for _ in range(60)]
    words += [misspelt(rng, w) for w in words] + [misspelt(rng, misspelt(rng, w)) for w in words]
    words += ["a" * k for k in (*range(6, 16), *range(60, 70))] + ["x" * 70 + "y", "x" * 71, "x" * 35 + "y" + "x" * 35]
    rows = [(d, " ".join(w for w in words for _ in range(rng.choice([0, 0, 1, 1, 2, 30]))) + rng.choice("1._×"), "x", 1) for d in range(12)]
    rows += [(None, "bananana BANANANA bananan5a", "x", 1), (3, None, "x", 1), (4, "", "x", 1), rows[0]]
    got = V.variants(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_chains_of_forms_lead_to_their_last(spark):
    rows = [(1, "lettersx " * 3 + "letters " * 40 + "letterz " * 2 + "lettexs " * 500, "x", 1)]
    got = {tuple(r) for r in V.variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows) and any(r[1] != r[2] for r in got if r[1])


def test_very_long_words_and_nothing(spark):
    a = "abcdefgh" * 5_000
    rows = [(1, " ".join([a] * 40 + [a + "x"] * 2 + [a[:20_000] + a[20_001:]] * 3 + [a[:9_000] + "zz" + a[9_002:]] * 2), "x", 1)]
    got = {(len(r.word), r.n, r.n_near, r.form_n) for r in V.variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert {g for g in got if g[1] > 1} >= {(40_001, 2, 1, 40), (39_999, 3, 1, 40), (40_000, 2, 0, None)}
    assert V.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert V.variants(spark.createDataFrame([(1, "one two", "x", 1)], DOCS)).count() == 0
