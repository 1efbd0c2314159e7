"""The classifier separates held-out rows; labels and ids are no inputs of a score."""

import math
import zlib

import numpy as np

from fixtures_llm import ODD, documents, no_docs, odd  # noqa: F401
from cohortloom.llm import quality as q

LABELS = "doc_id long, quality int"


def test_update_is_the_textbook_one():
    """One coordinate, by the rule written out."""
    model, z, n = q.Ftrl(), 0.0, 0.0
    at = np.array([5])
    for x, y in ((1.0, 1), (0.5, 0), (2.0, 1), (1.5, 1)):
        w = 0.0 if abs(z) <= q.L1 else -(z - math.copysign(q.L1, z)) / ((q.BETA + math.sqrt(n)) / q.ALPHA + q.L2)
        g = (1 / (1 + math.exp(-w * x)) - y) * x
        z, n = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / q.ALPHA * w, n + g * g
        model.learn(at, np.array([x]), y)
    assert np.allclose([model.z[5], model.n[5]], [z, n])


def test_score_is_the_sparse_product(spark):
    text = "The the cat!! sat 12 sat"
    weights = np.random.default_rng(1).normal(size=q.BUCKETS + 1).astype(np.float32)
    at, x = q._features(text)
    got = q.score(spark.createDataFrame([(text,)], "text string"), weights).first().score
    assert abs(got - q.sigmoid(float(weights[at].astype(float) @ x))) < 1e-9


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(bad) > 3
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(s >= 0.7 for s in good) / len(good) > 0.97


def test_held_out_labels_are_not_read(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    flip = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality) for r in labels]
    a, b = (q.train(documents, spark.createDataFrame(rows, LABELS))
            for rows in ([(r.doc_id, r.quality) for r in labels], flip))
    assert (a == b).all() and a.any()


def test_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (5, 1), (77, 0)], LABELS)
    for extra in ("score", "predicted"):
        got = q.classify(odd(extra), labels).collect()
        assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in ODD), key=repr)
        assert all(0 <= r.score <= 1 for r in got)
    kept = q.keep_good(odd("score"), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert q.classify(no_docs, labels).count() == 0
    none = q.classify(odd(), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(1.0, 1)}


def test_shape():
    assert [q.shape(w) for w in ("Word", "SHOUT!!", "a$$$", "x12", "|", "")] == ["Aa", "A!", "a$", "a9", "|", ""]
