import hashlib
import random

import pytest

from creditspark.llm import suffix as S


def brute(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                covered[p:p + length] = b"\1" * length
            else:
                seen.add(raw[p:p + length])
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out.append((d, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, length).collect()), key=str)


def tables():
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    small = [(i, word(rng.choice([0, 5, 19, 20, 40, 300]), "ab")) for i in range(60)]
    small += [(None, "x" * 500), (7, "ab" * 100), (7, "zz"), (61, None), (62, "x" * 500), (63, "é" * 40), (64, "aé" * 40)]
    passage = word(150, "abcdefgh ")
    hot = [(1000 - i, word(rng.randrange(200), "abcdefgh ") + passage[rng.randrange(20):150 - rng.randrange(20)] + word(rng.randrange(200), "abcdefgh "))
           for i in range(500)]
    return {"periods and repeats": (small, 20), "one hot passage": (hot, 100), "none": ([], 100)}


@pytest.mark.parametrize("name", tables())
@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, name, parts):
    rows, length = tables()[name]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, copy int").repartition(parts)
    assert found(df, length) == brute(rows, length)


def test_long_texts_in_parts_and_forgetful_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 700)
    monkeypatch.setattr(S, "REMEMBERED", 50)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    rows = [(3, base), (1, base[300:2500] + "!" + base[2600:]), (2, base[:50] * 90), (9, base[1000:1500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(df, 100) == brute(rows, 100)


def test_table_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(df, 100) == brute(rows, 100)
    kept = S.remove_repeats(df).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
