"""Codes and codebooks against plain rounds over all vectors; the tree by itself."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label string, code int"


def plain(rows):
    """(rows out, codebooks) by comparing every part with every entry, in Python integers."""
    kept = [(i, [max(-vc.MOST, min(vc.MOST, math.floor(4096 * x) if math.isfinite(4096 * x) else
                                   math.copysign(2 ** 63, x).__int__())) for x in v], lab)
            for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), lab) for i, v, lab in kept]
    parts = [[v[p * width:(p + 1) * width] for _, v, _ in kept] for p in range(8)]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:16]
    seeds = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[s[p * width:(p + 1) * width] for s in seeds] for p in range(8)]

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(p):
        return [min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e)) for x in parts[p]]

    for _ in range(6):
        for p in range(8):
            to = assign(p)
            for e in set(to):
                mine = [x for x, t in zip(parts[p], to) if t == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = [assign(p) for p in range(8)]
    errors = [min(sum(dist(parts[p][n], books[p][codes[p][n]]) for p in range(8)), 2 ** 63 - 1)
              for n in range(len(kept))]
    labels = {}
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] = labels.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{codes[p][n]:02x}" for p in range(8)), errors[n],
                    min(labels[lab], 2 ** 63 - 1), digest) for n, (i, _, lab) in enumerate(kept)), key=repr)


def check(spark, rows):
    got = vc.compress(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def clustered(draw, n, dims, groups=12):
    centres = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [[x + draw.gauss(0, 0.02) for x in draw.choice(centres)] for _ in range(n)]


def test_clusters_copies_and_labels(spark):
    draw = random.Random(1)
    vectors = clustered(draw, 300, 16)
    vectors += [vectors[0]] * 150  # a third of all rows are one vector
    check(spark, [(i * 3 % 1000, v, draw.choice(["a", "b", None])) for i, v in enumerate(vectors)])


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(5, [0.5] * 9, "a"), (5, [0.25] * 9, "a"), (5, [0.5] * 9, "a"), (None, [1.0, -1.0], None), (7, [], "b"),
            (1, None, "a"), (2, [0.1, None], "a"), (3, [nan] * 9, "b"), (4, [0.0, inf], "b"), (6, [-0.00001] * 3, "b"),
            (8, [1.5], "b"), (None, [2.0], "c")]
    check(spark, rows)


@pytest.mark.parametrize("size", [3e5, 1e11, 1e30, 1e306])
def test_large_numbers_stay_exact(spark, size):
    draw = random.Random(2)
    check(spark, [(i, [draw.uniform(-size, size) for _ in range(8)], "a") for i in range(60)])


def test_few_none_and_empty_vectors(spark):
    check(spark, [(i, [float(i)] * 8, None) for i in range(3)])
    check(spark, [(1, [], "a"), (2, [], "b")])
    check(spark, [])
    check(spark, [(1, None, "a")])


def test_many_blocks_give_the_same(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, v, "x") for i, v in enumerate(clustered(draw, 200, 24))]
    want = plain(rows)
    for parts in (1, 7):
        frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(parts)
        assert sorted((tuple(r) for r in vc.compress(frame).collect()), key=repr) == want


def test_tree_covers_and_parts_are_assigned_whole():
    draw = random.Random(4)
    rows = np.floor(4096 * np.array(clustered(draw, 3000, 8))).astype(float)
    tree = vc.cover_tree(rows)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    for n in range(len(tree.start)):
        inside = tree.order[tree.start[n]:tree.stop[n]]
        away = np.sqrt(vc.squared(rows[inside], rows[tree.pivot[n]][None])[:, 0])
        assert away.max() <= tree.radius[n] and tree.pivot[n] in inside
        if tree.children[n]:
            kids = range(tree.child[n], tree.child[n] + tree.children[n])
            assert sum(tree.stop[k] - tree.start[k] for k in kids) == len(inside)
            assert tree.pivot[n] in [tree.pivot[k] for k in kids]
            apart = vc.squared(rows[tree.pivot[list(kids)]], rows[tree.pivot[list(kids)]])
            np.fill_diagonal(apart, np.inf)
            assert np.sqrt(apart.min()) > tree.radius[n] / 2 / (1 + 1e-6)
    centres = rows[:1]  # one of each cluster, as a fitted codebook has them
    for r in rows:
        if vc.squared(r[None], centres).min() > 1000 ** 2:
            centres = np.concatenate([centres, r[None]])
    nodes, to, alone, alone_to = vc.nearest(tree, rows, centres)
    got = np.full(len(rows), -1)
    for n, t in zip(nodes, to):
        assert (got[tree.order[tree.start[n]:tree.stop[n]]] == -1).all()
        got[tree.order[tree.start[n]:tree.stop[n]]] = t
    got[alone] = alone_to
    assert (got == vc.squared(rows, centres).argmin(axis=1)).all()
    assert len(alone) < len(rows) / 4 and len(nodes) < len(rows) / 4
