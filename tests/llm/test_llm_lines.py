from collections import Counter

import pytest

from creditspark.llm import lines as L

SCHEMA = "doc_id long, text string, source string, n_chars long, _lines string, host string"


def brute(rows, ratio=0.1):
    total = Counter(r[2] for r in rows)
    seen = Counter((r[2], x) for r in rows if r[1] is not None for x in set(r[1].split("\n")) if x.strip(" "))
    bad = {k for k, n in seen.items() if n > 1 and n / total[k[0]] > ratio}
    out = []
    for r in rows:
        t = r[1]
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if (r[2], x) not in bad)
        out.append((r[0], t, r[2], r[3] if t == r[1] else len(t), r[4], r[5]))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_LINES", broadcast)
    rows = [(i, f"own {i} text with some length\nfooter of site\n\nown again {i}", "a" if i % 3 else None, 5, "x", "y") for i in range(30)]
    rows += [(40, None, "a", None, None, None), (41, "", "b", 0, None, None), (42, "footer of site", "a", 14, "", ""),
             (43, " \n\n", "a", 3, "", ""), (1, rows[1][1], "a", 5, "x", "y"), (None, "footer of site\n" + "z" * 300_000, "a", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = L.drop_boilerplate(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_small_hosts_and_a_line_at_the_ratio(spark):
    rows = [(i, "menu\nnotice" + ("\nrare" if i < 2 else "") + ("\ntold" if i < 3 else "") + f"\nown {i}", "a", 5, "", "") for i in range(20)]
    rows += [(30, "x\ny", "b", 3, "", ""), (31, "x\nz", "b", 3, "", ""), (32, "alone", "c", 5, "", "")]
    out = sorted(map(tuple, L.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert out == brute(rows)
    text = {r[0]: r[1] for r in out}
    assert text[0] == "rare\nown 0" and text[30] == "y" and text[32] == "alone"


def test_empty_table(spark):
    assert L.drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []
