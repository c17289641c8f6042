import gc
import random
import weakref

from pyspark.sql import Row

from creditspark.llm import decontaminate as D
from test_llm_words import shingle_tuples


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, u in items:
            s = shingle_tuples(u)
            if s and all(len(x) == 5 for x in s):
                shared = len(s & shingle_tuples(t))
                if shared >= 0.8 * len(s) - 1e-9:
                    out.append((d, i, shared, shared / len(s)))
    return sorted(out, key=str)


def test_against_brute_force_in_blocks(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 8, 12, 20, 20, 40, 60, 150, 700, 4, 0])] + [(20, None), (21, "w1 w2 w3 w4 w5"), (None, text(9))]
    docs = []
    for i, u in items:
        for edits in (0, 1, 2, 6, 40):
            w = (u or "").split()
            for _ in range(edits if w else 0):
                w[rng.randrange(len(w))] = "changed"
            docs.append((len(docs), text(rng.randrange(3, 900)) + " " + " ".join(w).upper() + ". " + text(50)))
    docs += [(900, None), (901, ""), (3, docs[0][1]), (None, items[3][1]), (902, text(300_000) + " " + items[4][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for block in (1 << 20, 60):
        assert sorted(map(tuple, D.contained(d, b, block).collect()), key=str) == want
    kept = D.drop_contaminated(d, b, 60)
    assert kept.columns == d.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, [
        Row(doc_id=d, text=t) for d, t in docs if not brute([(d, t)], items)]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert D.contained(some, items).collect() == [] and D.contained(none, items).collect() == []
    assert D.drop_contaminated(some, items).count() == 1


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    made, held, init = [], [], D.Block.__init__

    def watched(self, *args):
        gc.collect()
        held.append(sum(r() is not None for r in made))
        init(self, *args)
        made.append(weakref.ref(self))

    monkeypatch.setattr(D.Block, "__init__", watched)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(6)]
    docs = [(i, f"before {t} after") for i, t in items] + [(9, "none of them is in here, nor here"), (10, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = D.contained(d, b, 30)
    assert len(made) == 6 and max(held) == 0
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(6)]
    made.clear(), held.clear()
    kept = D.drop_contaminated(d, b, 30)
    assert len(made) == 6 and max(held) == 0
    assert sorted(r.doc_id for r in kept.collect()) == [9, 10]
