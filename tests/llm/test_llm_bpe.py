import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from creditspark.llm import bpe as B


@pytest.fixture(scope="module")
def own():
    return B.Tokenizer()


@pytest.fixture(scope="module")
def library():
    return Library.from_file(B.VOCABULARY)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abehilnorst 'dmve<|>\t", max_size=200)))
def test_any_text_as_the_library_does(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_chosen_texts_and_digests(spark, library):
    rng = random.Random(9)
    texts = [None, "", " \n", "a<|endoftext|>B <|startoftext|>", "<|endoftext|", "ΑΣΑΣ İ ß", "it's WE'LL don''t", "é x́", "日本 😀 ½ Ⅷ",
             "".join(rng.choice("abcdeth") for _ in range(9000)), "x" * 3000, "word " * 80_000, "1234 !!!???"]
    df = spark.createDataFrame([(i % 12, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.token_digests(df).collect())
    assert out == sorted((i % 12, *digests(library, t)) for i, t in enumerate(texts))
    assert B.token_digests(df.limit(0)).collect() == []
    ids = {r.doc_id: r.ids for r in B.encoded(df.where("doc_id = 4")).collect()}
    assert ids[4] == library.encode(texts[4], add_special_tokens=False).ids


def test_table_of_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: digests(library, r.text) for r in df.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.token_digests(df).collect()} == want


def test_stream_holds_a_bounded_window(own):
    """Tokens come out while the word is still being read, at most the sufficient lookahead behind."""
    rng = random.Random(3)
    word = "".join(rng.choice("aehinorst") for _ in range(20_000))
    read, lag, sent = [0], 0, 0

    def symbols():
        for c in word:
            read[0] += 1
            yield c

    for t in own.stream(symbols()):
        sent += len(own.strings[t].removesuffix("</w>"))
        lag = max(lag, read[0] - sent)
    assert sent == len(word) and lag <= own.lookahead and lag < 400


def test_lookahead_of_small_merge_lists():
    assert B.sufficient_lookahead([("a", "b")]) == 1
    assert B.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert B.sufficient_lookahead([]) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bytes_decoder_restores_words(own, text):
    machine = B.BytesDecoder(own)
    got = "".join(machine.feed(t) for t in own.encode(text)) + machine.finish()
    assert re.sub(r"\s", "", got) == re.sub(r"\s", "", B.normalized(text))
