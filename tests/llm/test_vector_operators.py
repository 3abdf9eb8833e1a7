"""Operators on vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from auditloom.llm import op8_ann, op9_embedding_dedup

ODD = [(9000, None, 1), (9020, [0.0] * 8, 1), (9040, [1.0, None] + [0.0] * 6, 1), (9060, [float("nan")] * 8, 1), (9080, [1.0] * 3, 1), (None, [1.0] * 8, 1)]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, 8)) * rng.choice([1.0, 2.0], (n // 3, 1))
    return [(i, [float(x) for x in base[rng.integers(len(base))]], int(rng.integers(3))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 0, "x") for r in data], "vec_id long, embedding array<double>, label int, cell long, b string")


@pytest.mark.parametrize(("n", "block"), [(300, 2048), (300, 16), (9, 2048), (1, 2048)])
def test_nearest(spark, n, block):
    data = rows(max(n, 3), 1)[:n]
    got: dict = {}
    for r in op8_ann.nearest(frame(spark, data + ODD), 20, block=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, v, _ in data:
        if q % 20:
            continue
        exact = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w, _ in data if i != q)
        found = sorted(got.get(q, []))
        assert [r for r, *_ in found] == list(range(1, min(20, len(data) - 1) + 1))
        scores = {i: -s for s, i in exact}
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in found) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in exact[:20]})
        total += len(exact[:20])
    assert hits >= 0.9 * total and set(got) <= {q for q, *_ in data}


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(9)
    for d in (4, 64):
        entries = np.zeros((300, d))
        entries[:, 1] = rng.permutation(np.arange(300) + 1.0)
        entries[200:, 0] = -1.0
        members = [[i, i + 1000] if i % 2 else [i] for i in rng.permutation(300).tolist()]
        query = np.eye(d)[:1]
        ((_, ids, scores),) = op8_ann.best(query, [17], entries, members, 20)
        level = sorted((x for m in members[:200] for x in m if x != 17))[:20]
        assert ids == level and scores == [0.0] * 20
    # 240 vectors on two axes, so that all of an axis share their cells and all but equals tie.
    data = [(i, [1.0, 1e-3 * (i + 1)] + [0.0] * 6 if i % 2 else [1e-3 * (i + 1), 1.0] + [0.0] * 6, 1) for i in range(240)] + [(400, [1.0] + [0.0] * 7, 1)]
    got = sorted((r.rank, r.vec_id) for r in op8_ann.nearest(frame(spark, data), 400).collect() if r.query_id == 400)
    assert [i for _, i in got] == list(range(1, 41, 2))


def test_settings_bound_cells():
    for n in (1, 2000, 50_000, 200_000, 10**6, 16 * 10**6):
        fine, probes = op8_ann.settings(n, 64)
        assert n / (128 * fine) <= 4 * op8_ann.CELL and probes <= 128 * fine
    assert op8_ann.settings(10**6, 64)[0] > op8_ann.settings(200_000, 64)[0] > 1


def random_units(n, seed=3):
    """The hardest case: no structure at all, so the 20 nearest are hardly nearer than the rest."""
    x = np.random.default_rng(seed).standard_normal((n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top_of(x, every):
    near = x[::every] @ x.T
    near[np.arange(len(near)), np.arange(0, len(x), every)] = -9
    return np.argsort(-near, axis=1)[:, :20]


@pytest.mark.parametrize("fine", [1, 4])
def test_recall_of_random_vectors(spark, fine):
    """The whole search, with production's probes for as many cells."""
    x = random_units(6000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    probes = None if fine == 1 else op8_ann.settings(fine * 128 * op8_ann.CELL, 64)[1]
    got: dict = {}
    for r in op8_ann.nearest(df, 100, fine=fine, probes=probes).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    top = top_of(x, 100)
    found = sum(len(got[100 * i] & set(t)) for i, t in enumerate(top.tolist())) / top.size
    assert found >= (0.9 if fine == 1 else 0.87)  # nearest of so few vectors lie further away than those of the tables that get four cells


@pytest.mark.parametrize("fine", [1, 2, 4, 8, 16, 64, 128])
def test_recall_by_production_settings(fine):
    """Which entries share a cell with each query, for the cells and probes of each size of table; 40,000 vectors stand in for it."""
    chosen, probes = op8_ann.settings(max(fine * 128 * op8_ann.CELL, 40_000), 64)
    assert chosen == fine
    x, every = random_units(40_000), 250
    top = top_of(x, every)
    met = np.zeros(top.shape, bool)
    for t in range(op8_ann.TABLES):
        stored = np.concatenate([op8_ann.cells_of(x[i : i + 4000], t, 1, fine)[:, 0] for i in range(0, len(x), 4000)])
        asked = op8_ann.cells_of(x[::every], t, probes, fine)
        met |= (stored[top][:, :, None] == asked[:, None, :]).any(axis=2)
    assert met.mean() >= 0.9


def test_cells():
    x = np.random.default_rng(2).standard_normal((50, 64))
    r = op8_ann.rotate(x, 3)
    assert np.allclose(np.linalg.norm(r, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(r @ r.T, x @ x.T)
    assert (op8_ann.cells_of(x, 0, 5, 1)[:, :1] == op8_ann.cells_of(x, 0, 1, 1)).all()
    assert (op8_ann.cells_of(x, 0, 5, 2)[:, :1] == op8_ann.cells_of(x, 0, 1, 2)).all()


@pytest.mark.parametrize("options", [{}, {"leaf": 40}, {"leaf": 40, "block": 16}])
def test_embedding_dedup(spark, options):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.standard_normal(64)], i % 3) for i in range(200)]
    data += [(1000 + i, [x * (1 + 1e-2 * rng.standard_normal()) for x in data[i % 5][1]], data[i % 5][2]) for i in range(80)] + [(2000 + i, data[3][1], data[3][2]) for i in range(20)]
    odd = [(i, v, label) for i, v, label in ODD if i is not None] + [(9100, data[0][1], None), (7, data[7][1], 5)]
    got = op9_embedding_dedup.embedding_components(frame(spark, data + odd), **options).collect()
    assert len(got) == len(data + odd)
    x = np.array([r[1] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in data])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    by = {r.vec_id: r for r in got if r.vec_id != 7}
    assert sum(by[i].n_links for i, *_ in data if i != 7) >= 0.9 * linked.sum()
    assert all(by[i].n_links <= n for (i, *_), n in zip(data, linked.sum(axis=1), strict=True) if i != 7)
    assert all(by[r[0]].n_links == 0 and by[r[0]].kept for r in odd if r[0] != 7)
    assert {by[1000 + i].component_id for i in range(5)} == {0, 1, 2, 3, 4}


def test_pairs_near_the_threshold_meet_in_deep_trees(spark):
    """Pairs at a cosine of 0.93 to 0.95 among trees of depth 7, where leaves alone decide."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((500, 64))
    noise -= (noise * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    cosine = rng.uniform(0.931, 0.95, (500, 1))
    near = cosine * x[:500] + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    data = [(i, v) for i, v in enumerate(np.concatenate([x, near]).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in op9_embedding_dedup.embedding_components(df, leaf=40).collect()}
    linked = [i for i in range(500) if got[4000 + i].component_id == i]
    assert len(linked) >= 0.97 * 500 and all(got[i].n_links == 0 for i in range(500, 4000))


def test_empty_tables(spark):
    empty = frame(spark, ODD).limit(0)
    assert op8_ann.nearest(empty, 20).count() == 0
    assert op9_embedding_dedup.embedding_components(empty).count() == 0
    assert op9_embedding_dedup.embedding_components(frame(spark, ODD)).count() == len(ODD)
