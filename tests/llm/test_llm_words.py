import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from creditspark.llm import words as W

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingle_tuples(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab, .É\n9", max_size=60)), min_size=1, max_size=6))
def test_shingles_agree_with_tuples(texts):
    made = W.shingle_sets(pa.array(texts, pa.string()))
    tuples = [shingle_tuples(t) for t in texts]
    assert [len(m) for m in made] == [len(t) for t in tuples]
    for a, x in zip(made, tuples):
        for b, y in zip(made, tuples):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = pa.array(["ab cde " * 300 + "x" * 500, None, "z " * 40])
    whole = W.words(*W.lowered(text))
    monkeypatch.setattr(W, "CHUNK", 64)
    parts = W.words(*W.lowered(text))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_words_of_a_megabyte_take_little_memory(monkeypatch):
    raw = W.lowered(pa.array(["some words of a text " * 50] * 1000))
    monkeypatch.setattr(W, "_powers", [])
    tracemalloc.start()
    W.words(*raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6
