"""Near copies of embeddings against all pairs."""

import numpy as np
import pytest

from creditspark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<double>, label int, node long, w int"


def brute(rows, least=0.9):
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    units = [np.array(v) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, usable)]
    units = [v if v is None else v / np.linalg.norm(v) for v in units]
    linked = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least]
              for i in range(len(rows))]
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        head = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(linked[i]), head, vec is not None and vec == head))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2) for i, v in rows], SCHEMA)
    out = E.near_copies(df.repartition(parts))
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((tuple(r) for r in out.collect()), key=key)


def clusters(rng, n, size, dim, noise):
    rows = []
    for c in rng.normal(size=(n, dim)):
        for _ in range(rng.integers(1, size)):
            rows.append(c / np.linalg.norm(c) + rng.normal(size=dim) * noise / np.sqrt(dim))
    return [(int(i), list(v)) for i, v in zip(rng.permutation(len(rows)) + 5, rows)]


@pytest.mark.parametrize("block", [512, 3])
def test_tight_clusters_copies_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = clusters(rng, 40, 20, 16, 0.1)
    v = rows[0][1]
    rows += [(1000 + i, v) for i in range(50)] + [(2000 + i, list(3.5 * np.array(v))) for i in range(5)] + [(2100, list(-np.array(v)))]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] * 16), (3005, []),
             (3006, v[:5]), (3007, v[:5]), (None, v), (None, None), (1000, v), (1001, [9.0] + [0.0] * 15), (3008, [1e200 * c for c in v]), (3009, [1e-200 * c for c in v])]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_links_at_the_threshold(spark):
    """Pairs just above it are linked where the index finds them, pairs just below it never."""
    rng = np.random.default_rng(9)
    rows = []
    for k, c in enumerate(np.linspace(0.9 - 1e-6, 0.9 + 1e-6, 200)):
        v, u = rng.normal(size=(2, 24))
        v /= np.linalg.norm(v)
        u -= (u @ v) * v
        rows += [(2 * k, list(v)), (2 * k + 1, list(c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u)))]
    got, want = run(spark, rows), sorted(brute(rows), key=key)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) >= 150


def test_wide_clusters_reach_the_recall_and_link_nothing_below(spark):
    rng = np.random.default_rng(5)
    rows = clusters(rng, 150, 30, 32, 0.42)
    got, want = run(spark, rows), sorted(brute(rows), key=key)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_ > 3000 and 0.95 * all_ <= found <= all_
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_nothing_and_one(spark):
    assert run(spark, []) == [] and run(spark, [(7, [1.0, 2.0])]) == [(7, 0, 7, True)]
    assert run(spark, [(7, None), (None, None)]) == sorted([(7, 0, 7, True), (None, 0, None, False)], key=key)


def test_traversal_visits_all_cells_up_to_the_gap_nearest_first():
    rng = np.random.default_rng(2)
    index = E.Index(rng.normal(size=(500, 10)).tolist(), 10, 2000, 0.9)
    a, b = index.halves(index.units(rng.normal(size=(20, 10)).tolist()))
    for p, q in zip(a, b):
        sums = (p[:, None] + q).reshape(-1)
        cells = index.visit(p, q)
        assert (np.diff(sums[cells]) >= 0).all()
        assert set(cells) == set(np.flatnonzero(sums <= sums.min() + index.gap))
