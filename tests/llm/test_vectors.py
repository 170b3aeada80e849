"""Vector links and components against brute force; recall of the graphs."""

import tracemalloc

import numpy as np
import pytest

from silverloom.llm import vectors


def sample(seed=1, spread=600, groups=((150, 0.03), (40, 0.04), (2, 0.02), (2, 0.05), (2, 0.05)), dim=16):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(spread)]
    for size, noise in groups:
        center = rng.standard_normal(dim)
        rows += [center + noise * np.linalg.norm(center) * rng.standard_normal(dim) for _ in range(size)]
    rows += [rows[0]] * 30 + [rows[0] * 2, rows[1] * 1e-30]
    return [r.astype(np.float32) for r in rows]


def brute(rows):
    """rows: (id, vector or None): number of links, and component."""
    fine = []
    for i, v in rows:
        ok = i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fine.append(np.array(v, float) if ok else None)
    n, root = [0] * len(rows), {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = fine[a], fine[b]
            if x is not None and y is not None and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    n[a] += 1
                    n[b] += 1
                    low, high = sorted((find(rows[a][0]), find(rows[b][0])))
                    root[high] = low
    return sorted((-1 if i is None else i, k, None if i is None else find(i), i is not None and find(i) == i) for (i, _), k in zip(rows, n))


def found(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cid int, component string")
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect())


def test_against_brute_force(spark):
    rows = [(1000 - 3 * i, v) for i, v in enumerate(sample())]
    nan, inf = float("nan"), float("inf")
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [nan] + [1.0] * 15), (5004, [inf] + [1.0] * 15), (5005, [None] + [1.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, sample()[0]), (5008, [1e38] * 16), (5009, [1e-38] * 16), (-2000 + 1, [1.0, -1.0])]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, [(4, None)]) == [(4, 0, 4, True)]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_one_graph():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 32))
    rows = vectors.normal(np.concatenate([rng.standard_normal((1500, 32)), *(c + 0.15 * rng.standard_normal((k, 32)) for c, k in zip(centers, [400] + [2] * 39))]))
    graph, exact, more = vectors.Graph.load(vectors.Graph.build(rows.astype(np.float32)).dump(rows, cid=np.arange(len(rows))))
    assert np.allclose(exact, rows) and (more["cid"] == np.arange(len(rows))).all()
    true = rows @ rows.T >= 0.9
    who, node = graph.search(rows.astype(np.float32), 32, 0.9)
    assert true[who, node].mean() > 0.999 and len(who) >= 0.99 * true.sum()
    got = np.zeros_like(true)
    for first, who, node, _ in vectors.audited_search(graph, rows, rows, 0.9):
        got[first + who, node] = True
    assert (got <= true).all() and got.sum() >= 0.995 * true.sum()


def test_beam_widens_until_the_audit_passes():
    """A graph without links finds only its entry; the widest beam reads everything."""
    rng = np.random.default_rng(5)
    rows = vectors.normal(np.repeat(rng.standard_normal((20, 8)), 3, 0) + 1e-3 * rng.standard_normal((60, 8)))
    graph = vectors.Graph(rows.astype(np.float32), [np.full((60, 4), -1, np.int32)], 0)
    got = [(first + w, x, beam) for first, who, node, beam in vectors.audited_search(graph, rows, rows, 0.9) for w, x in zip(who, node)]
    assert len(got) == (rows @ rows.T >= 0.9).sum() and {b for *_, b in got} == {60}


def test_a_large_group_does_not_hide_lost_pairs():
    """Pairs that no link leads to are a tiny part of all links; the audit sees them all the same."""
    rng = np.random.default_rng(6)
    center, pairs = rng.standard_normal(16), np.repeat(rng.standard_normal((60, 16)), 2, 0)
    rows = vectors.normal(np.concatenate([center + 0.02 * rng.standard_normal((600, 16)), pairs + 0.01 * rng.standard_normal((120, 16))]))
    graph = vectors.Graph.build(rows[:600].astype(np.float32))
    layers = [np.concatenate([x, np.full((120, x.shape[1]), -1, np.int32)]) for x in graph.layers]
    cut, number = vectors.Graph(rows.astype(np.float32), layers, graph.entry), np.arange(720)
    got = sum(len(who) for _, who, _, _ in vectors.audited_search(cut, rows, rows, 0.9, own=number, names=number))
    assert got == (rows @ rows.T >= 0.9).sum()


def test_a_dense_group_is_searched_in_little_memory(monkeypatch):
    """All links of a group of which every member hits every other, however few hits may be held."""
    rng = np.random.default_rng(8)
    center = rng.standard_normal(24)
    rows = vectors.normal(np.concatenate([center + 0.05 * rng.standard_normal((2500, 24)), rng.standard_normal((300, 24))]))
    graph, true = vectors.Graph.build(rows.astype(np.float32)), rows @ rows.T >= 0.9
    for hits, front in ((vectors.HITS, vectors.FRONT), (20_000, 500), (1, 100)):
        monkeypatch.setattr(vectors, "HITS", hits)
        monkeypatch.setattr(vectors, "FRONT", front)
        asked = np.arange(0, 2800, 7) if hits > 1 else np.arange(0, 2800, 100)
        tracemalloc.start()
        got = np.zeros((len(asked), 2800), bool)
        for first, who, node, _ in vectors.audited_search(graph, rows, rows[asked], 0.9):
            got[first + who, node] = True
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == true[asked]).all() and peak < 300_000_000


@pytest.mark.parametrize("scale", [1e-35, 1.0, 1e35])
def test_scale_does_not_matter(scale):
    assert np.allclose(vectors.normal(np.array([[3.0, 4.0]]) * scale), [[0.6, 0.8]])
