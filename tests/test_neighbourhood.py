"""Near graph, layout and projection against brute force and PCA."""

import numpy as np
import pytest

from cohortloom.operators import neighbourhood as nb

CLASSES, EACH, DIMS = 8, 90, 12


def made(seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((CLASSES, DIMS)) * 2.5
    kinds = np.repeat(np.arange(CLASSES), EACH)
    x = centres[kinds] + rng.standard_normal((len(kinds), DIMS))
    x[1:20] = x[0]  # equal samples
    return kinds, x


def squares(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(axis=2)


def trust(x, y, k=10):
    """Trustworthiness: how few of the neighbours in y are strangers in x."""
    n = len(x)
    dx, dy = squares(x, x), squares(y, y)
    np.fill_diagonal(dx, -1)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, axis=1, kind="stable"), axis=1)
    near = np.argsort(dy, axis=1, kind="stable")[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def fitted(spark):
    kinds, x = made()
    rows = nb.points(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                           "sample_id long, vec array<double>"))
    graph = nb.near_graph(rows)
    tied = nb.ties(graph)
    return kinds, x, rows, graph, tied, nb.layout(rows, tied)


def test_graph_finds_the_nearest(fitted):
    _, x, _, graph, _, _ = fitted
    d = squares(x, x)
    np.fill_diagonal(d, np.inf)
    reach = np.sort(d, axis=1)[:, nb.NEAR - 1]
    found = {r.sample_id: r.near for r in graph.collect()}
    assert len(found) == len(x)
    for s, near in found.items():
        assert len(near) == nb.NEAR and s not in {n.id for n in near}
        assert [(n.d, n.id) for n in near] == sorted({(n.d, n.id) for n in near})
        assert all(abs(n.d - d[s, n.id]) < 1e-9 for n in near)
    hits = sum(n.d <= reach[s] + 1e-9 for s, near in found.items() for n in near)
    assert hits / (len(x) * nb.NEAR) >= 0.9


def test_ties_are_the_same_both_ways(fitted):
    rows = fitted[4].collect()
    ways = {(r.sample_id, r.near_id): r.w for r in rows}
    assert all(0 < w <= 1 + 1e-12 for w in ways.values())
    assert all(abs(ways[b, a] - w) < 1e-12 for (a, b), w in ways.items() if (b, a) in ways)


def test_layout_keeps_neighbourhoods_better_than_pca(fitted):
    kinds, x, _, _, _, placed = fitted
    at = {r.sample_id: (r.x, r.y, r.z) for r in placed.collect()}
    y = np.array([at[i] for i in range(len(x))])
    assert np.isfinite(y).all()
    centred = x - x.mean(axis=0)
    flat = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    ours, theirs = trust(x, y), trust(x, flat)
    print("trustworthiness", ours, "pca", theirs)
    assert ours > theirs and ours > 0.9


def test_new_samples_come_to_their_class(fitted, spark):
    kinds, x, rows, _, tied, placed = fitted
    rng = np.random.default_rng(9)
    centres = np.array([x[kinds == c].mean(axis=0) for c in range(CLASSES)])
    guests = centres + 0.5 * rng.standard_normal(centres.shape)
    new = nb.points(spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(guests)],
                                          "sample_id string, vec array<double>"))
    near = nb.nearest_known(new, rows, tied)
    reach = np.sort(squares(guests, x), axis=1)[:, nb.NEAR - 1]
    got = {r.sample_id: r.near for r in near.collect()}
    hits = sum(n.d <= reach[i] + 1e-9 for i in range(CLASSES) for n in got[f"n{i}"])
    assert hits >= 0.9 * CLASSES * nb.NEAR
    at = {r.sample_id: (r.x, r.y, r.z) for r in placed.collect()}
    y = np.array([at[i] for i in range(len(x))])
    for r in nb.place(near, placed).collect():
        nearest = kinds[np.argsort(squares(np.array([[r.x, r.y, r.z]]), y)[0])[:5]]
        assert (nearest == int(r.sample_id[1:])).sum() >= 3


@pytest.mark.parametrize("rows, n", [
    ([], 0),
    ([("a", [1.0, 2.0, 3.0])], 1),
    ([("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 3.0]), ("a", [1.0, 2.0, 3.0])], 2),
    ([("a", [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), ("c", None), ("d", [0.0, 0.0, 9.0])], 2)])
def test_odd_rows(spark, rows, n):
    ready = nb.points(spark.createDataFrame(rows, "sample_id string, vec array<double>"))
    tied = nb.ties(nb.near_graph(ready))
    placed = nb.layout(ready, tied, sweeps=1).collect()
    assert len(placed) == n and all(np.isfinite([r.x, r.y, r.z]).all() for r in placed)
    assert nb.place(nb.nearest_known(ready, ready, tied), nb.layout(ready, tied, sweeps=1)).count() == (n > 0) * n


@pytest.mark.parametrize("size", [1, nb.WALK_BYTES])
def test_walk_follows_every_link_once(fitted, spark, monkeypatch, size):
    """The plain walk's result, whatever walks together; alone, a sample asks for each link's ties once."""
    _, x, rows, _, tied, _ = fitted
    ways = {}
    for r in tied.collect():
        ways.setdefault(r.sample_id, set()).add(r.near_id)
    guests = np.random.default_rng(3).standard_normal((12, DIMS)) * 2
    want, followed = {}, 0
    for g, d in enumerate(squares(guests, x)):
        listed, met = sorted((e, i) for i, e in enumerate(d))[:nb.STARTS], set()
        while {i for _, i in listed} - met:
            fresh = {i for _, i in listed} - met
            met |= fresh
            around = {i for _, i in listed}.union(*(ways[i] for i in fresh))
            listed = sorted((d[i], i) for i in around)[:nb.NEAR]
        want[f"n{g}"], followed = listed, followed + len(met)
    new = nb.points(spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(guests)],
                                          "sample_id string, vec array<double>"))
    asked, write = [], nb.cut

    def counted(df):
        out = write(df)
        asked.append(out.count() if {"_block", "next"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(nb, "cut", counted)
    monkeypatch.setattr(nb, "WALK_BYTES", size)
    got = {r.sample_id: r.near for r in nb.nearest_known(new, rows, tied, rounds=30).collect()}
    assert got.keys() == want.keys()
    for s, near in want.items():
        assert [n.d for n in got[s]] == pytest.approx([d for d, _ in near])
    assert 0 < sum(asked) <= followed
