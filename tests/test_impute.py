import math

import numpy as np
import pytest

from cohortloom.operators import impute

M = "sample_id string, probe_id string, m_value double"


def brute(matrix, k):
    """Nearest-neighbour filling of a small array, cell by cell."""
    n, p = matrix.shape
    out = matrix.copy()
    for i in range(n):
        for j in range(p):
            if not math.isnan(matrix[i, j]):
                continue
            near = []
            for d in range(n):
                if math.isnan(matrix[d, j]):
                    continue
                both = ~np.isnan(matrix[i]) & ~np.isnan(matrix[d])
                if both.any():
                    gap = ((matrix[i, both] - matrix[d, both]) ** 2).sum()
                    near.append((round(math.sqrt(p / both.sum() * gap), 9), d))
            near = sorted(near)[:k]
            known = matrix[~np.isnan(matrix[:, j]), j]
            out[i, j] = np.mean([matrix[d, j] for _, d in near]) if near else known.mean()
    return out


def drawn(n=40, p=6, share=0.25, seed=3):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, p))
    matrix[rng.random((n, p)) < share] = np.nan
    matrix[7] = np.nan
    matrix[8] = matrix[9]
    return matrix


def long(frame, matrix):
    return frame([(f"s{i:02d}", f"p{j}", None if math.isnan(v) else float(v))
                  for i, row in enumerate(matrix) for j, v in enumerate(row)], M)


@pytest.mark.parametrize("block", [2048, 7])
def test_knn_equals_brute_force(frame, block):
    matrix = drawn()
    got = impute.impute_knn(long(frame, matrix), k=3, block=block).collect()
    want = brute(matrix, 3)
    assert len(got) == matrix.size
    for r in got:
        i, j = int(r.sample_id[1:]), int(r.probe_id[1:])
        assert r.m_value == pytest.approx(want[i, j], abs=1e-9)
        assert r.imputed == math.isnan(matrix[i, j])


def test_only_asked_samples_are_filled(frame):
    matrix = drawn()
    asked = frame([("s07",)], "sample_id string")
    got = impute.impute_knn(long(frame, matrix), targets=asked).filter("imputed").collect()
    assert {r.sample_id for r in got} == {"s07"} and len(got) == 6


def test_mean_comes_from_the_cohort(frame, rows):
    m = frame([("a", "p", None), ("a", "q", 1.0), ("b", "p", 4.0)], M)
    cohort = frame([("c", "p", 2.0), ("d", "p", 6.0), ("e", "p", 7.0)], M)
    assert rows(impute.impute_mean(m, cohort)) == [
        ("a", "p", 5.0, True), ("a", "q", 1.0, False), ("b", "p", 4.0, False)]


def test_vectors_hold_known_features_by_number(frame):
    m = frame([("a", "q", 1.0), ("a", "q", 3.0), ("a", "p", 5.0), ("b", "x", 3.0), ("c", "p", None)], M)
    table = impute.feature_table(m, ["p", "q"])
    number = {r.probe_id: r.j for r in table.collect()}
    assert sorted(number) == ["p", "q"] and sorted(number.values()) == [0, 1]
    got = {r.sample_id: dict(zip(r.js, r.vs)) for r in impute.sample_vectors(m, table).collect()}
    assert got == {"a": {number["q"]: 2.0, number["p"]: 5.0}, "b": {}, "c": {}}


def test_bounds_never_exceed_a_distance():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.8):
        a, b = rng.normal(size=(30, 7)), rng.normal(size=(20, 7)) + 2
        a[rng.random(a.shape) < share] = np.nan
        b[rng.random(b.shape) < share] = np.nan
        known = ~np.isnan(b)
        bound = impute.lower_bounds(a, np.where(known, b, np.inf).min(axis=0),
                                    np.where(known, b, -np.inf).max(axis=0),
                                    known.all(axis=0), known.any(axis=0))
        assert (bound <= impute._distances(a, b).min(axis=1) + 1e-6).all()
        assert share or (bound > 0).any()


def test_far_blocks_are_not_met(frame):
    """Eight clusters, far apart: what meets beyond its own cluster is nothing."""
    rng = np.random.default_rng(11)
    kind = np.arange(240) % 8
    matrix = 100.0 * kind[:, None] + rng.normal(size=(240, 6))
    gaps = rng.random(matrix.shape) < 0.1
    matrix[gaps] = np.nan
    m = frame([(f"s{i:03d}", f"p{j}", None if math.isnan(v) else float(v))
               for i, row in enumerate(matrix) for j, v in enumerate(row)], M)
    table = impute.feature_table(m)
    placed, n_blocks = impute.blocks_of(impute.sample_vectors(m, table), 6, block=8)
    targets = placed.filter("size(js) < 6 and size(js) > 0").cache()
    home = impute.neighbours(targets, placed.limit(0), 1, 6)
    assert home.count() == 0
    block = {r.sample_id: r.block for r in placed.collect()}
    kinds = {}
    for sample, b in block.items():
        kinds.setdefault(b, set()).add(int(kind[int(sample[1:])]))
    near = impute._meet(
        targets.selectExpr("sample_id", "js", "vs", "block tb", "block db"),
        placed.selectExpr("sample_id donor_id", "js donor_js", "vs donor_vs", "block tb2", "block db2"),
        6, 2)
    pairs = impute.surviving_pairs(targets, placed, n_blocks, near, 6, 2).collect()
    full = {r.sample_id for r in near.groupBy("sample_id", "j").count().groupBy("sample_id").agg(
        {"count": "min"}).filter("`min(count)` = 2").collect()}
    far = [p for p in pairs if p.sample_id in full
           and int(kind[int(p.sample_id[1:])]) not in kinds[p.db]
           and kinds[block[p.sample_id]] == {int(kind[int(p.sample_id[1:])])}]
    assert far == []
    assert len(pairs) < 0.5 * targets.count() * n_blocks
    want = brute(matrix, 2)
    for r in impute.impute_knn(m, k=2, block=8).filter("imputed").collect():
        assert r.m_value == pytest.approx(want[int(r.sample_id[1:]), int(r.probe_id[1:])], abs=1e-9)


def test_nothing_to_fill(frame):
    none = frame([], M)
    assert impute.impute_knn(none).count() == 0
    whole = frame([("a", "p", 1.0), ("b", "p", 2.0)], M)
    assert impute.impute_knn(whole).filter("imputed").count() == 0
    lone = frame([("a", "p", None), ("a", "q", 1.0)], M)
    assert [tuple(r) for r in impute.impute_knn(lone).filter("imputed").collect()] == [
        ("a", "p", None, True)]


def test_blocks_are_met_in_squares(frame, monkeypatch):
    """A donor goes once to each group of target blocks, and any size of group gives the same values."""
    sent, meet = [], impute._meet

    def spied(left, right, *more):
        sent.append(right.count())
        return meet(left, right, *more)

    monkeypatch.setattr(impute, "_meet", spied)
    matrix = drawn()
    want = brute(matrix, 3)
    for size in (16, 2):
        monkeypatch.setattr(impute, "GROUP", size)
        for r in impute.impute_knn(long(frame, matrix), k=3, block=7).filter("imputed").collect():
            assert r.m_value == pytest.approx(want[int(r.sample_id[1:]), int(r.probe_id[1:])], abs=1e-9)
    home, far, _, smaller = sent
    assert home <= 40 and far <= 40 < smaller
