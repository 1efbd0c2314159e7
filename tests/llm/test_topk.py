"""Results equal a comparison of every query with every vector."""

import math
import random

import pytest

from cohortloom.llm import topk


def brute(rows, k=10, every=100):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            score = lambda b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))  # noqa: B023, E731
            found = sorted((-score(b), c) for c, b in fine if c != q)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return sorted(tuple(r) for r in topk.top_k(df, **more).collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)


def test_many_ranges_and_blocks(spark, monkeypatch):
    """Small ranges, clusters, ties and copies; the bounds must cut blocks off without loss."""
    monkeypatch.setattr(topk, "RANGE", 64)
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(c + rnd.gauss(0, 0.1), 2) for c in rnd.choice(centres)]) for i in range(500)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]
    assert run(spark, rows, query_every=20) == brute(rows, every=20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [1.0, None]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.5]), (8, [0.0001, -0.0001]),
            (9, [1e305, 1e305]), (200, []), (10, [3.0])]
    assert run(spark, rows) == brute(rows)


def test_sums_beyond_doubles(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, 2.0]), (3, [2.0**60, 0.0]), (4, [-(2.0**60), 0.0])]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 4


def test_repeated_queries_and_empty(spark):
    got = run(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])])
    assert got == [(0, 1, 1, 2048 * 1024)] * 2
    assert run(spark, []) == []


def test_blocks_are_skipped(monkeypatch):
    """Once the k-th score is above a block's bound, the block is not scored."""
    import numpy as np

    vectors = np.concatenate([np.full((topk.BLOCK, 2), 5.0), np.full((topk.BLOCK, 2), -5.0)])
    low, high = topk.blocks(vectors)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            read.extend([at] if isinstance(at, slice) else [])
            return super().__getitem__(at)

    found = topk.best_of(np.array([1.0, 1.0]), -1, -10**9, 3, np.arange(2 * topk.BLOCK), vectors.view(Seen),
                         np.array([10.0, -10.0]))
    assert found[0].tolist() == [0, 1, 2] and len(read) == 1
    assert (low == [[5, 5], [-5, -5]]).all() and (high == low).all()


@pytest.mark.parametrize("dims", [0, 1, 3])
def test_padded(dims):
    import numpy as np

    assert topk.padded(np.ones((2, dims)), 3).shape == (2, 3)
