import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evaluate as ev

CALLS = "actual string, predicted string"


def test_counts_use_all_classes(frame):
    calls = frame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "z"), ("c", "a")], CALLS)
    got = {r["class"]: (r.tp, r.fp, r.fn, r.tn, r.support) for r in ev.class_counts(calls).collect()}
    assert got == {"a": (1, 1, 1, 2, 2), "b": (1, 1, 1, 2, 2), "c": (0, 0, 1, 4, 1),
                   "z": (0, 1, 0, 4, 0)}
    z = ev.class_metrics(calls).filter("class = 'z'").first()
    assert (z.sensitivity, z.specificity, z.youden_index) == (0.0, 0.8, pytest.approx(-0.2))


def test_report(frame):
    calls = frame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "b")], CALLS)
    r = {x["class"]: x for x in ev.class_report(calls).collect()}
    assert (r["a"].precision, r["a"].recall) == (1.0, 0.75)
    assert r["c"].precision == r["c"].recall == r["c"].f1_score == 0.0
    assert r["accuracy"].f1_score == pytest.approx(5 / 7)
    assert r["macro avg"].recall == pytest.approx((0.75 + 1 + 0) / 3)
    assert r["weighted avg"].recall == pytest.approx((0.75 * 4 + 1 * 2) / 7)
    assert r["weighted avg"].support == 7


def test_share_of_nothing_is_zero(frame):
    empty = frame([], "v double")
    assert ev.share_above(empty, "v", 0.5).first().share == 0.0
    assert ev.share_above(frame([(0.5,), (0.6,)], "v double"), "v", 0.5).first().share == 0.5


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_is_the_rank_sum(spark, digits):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 800)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * label, 0.2), 0, 1), digits)
    df = spark.createDataFrame(
        [("pos", "pos" if y else "neg", float(s)) for y, s in zip(label, score)] +
        [("neg", "pos" if y else "neg", float(1 - s)) for y, s in zip(label, score)],
        "class string, actual string, score double")
    gap = score[label == 1][:, None] - score[label == 0][None, :]
    want = (gap > 0).mean() + (gap == 0).mean() / 2
    got = {r["class"]: r.auc for r in ev.roc_auc(df).collect()}
    # Each class is scored against its own indicator, so both curves agree.
    assert got["pos"] == pytest.approx(want, abs=1e-9)
    assert got["neg"] == pytest.approx(want, abs=1e-9)
    points = [r for r in ev.roc_points(df).filter("class = 'pos'").collect()]
    assert len(points) == len(set(score)) + 1
    xy = sorted((p.fpr, p.tpr) for p in points)
    assert xy[0] == (0.0, 0.0) and xy[-1] == (1.0, 1.0)
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xy, xy[1:])) == \
        pytest.approx(want, abs=1e-9)


def test_one_sided_class_has_no_auc(frame):
    df = frame([("a", "a", 0.1), ("a", "a", 0.9)], "class string, actual string, score double")
    assert ev.roc_auc(df).first().auc is None


def test_binary_scores(frame):
    df = frame([("t", 1, 0.9), ("t", 0, 0.5), ("t", 1, 0.4), ("v", 0, 0.1), ("v", 1, 0.8)],
               "split string, label int, probability double")
    got = {r.split: r for r in ev.binary_scores(df).collect()}
    assert got["t"].accuracy == pytest.approx(1 / 3)
    assert got["t"].brier_score == pytest.approx((0.01 + 0.25 + 0.36) / 3)
    assert got["t"].roc_auc == 0.5 and got["v"].roc_auc == 1.0


def test_correct_calls(frame):
    calls = frame([("a", "a", 1.0), ("a", "a", 0.95), ("a", "b", 0.99), ("b", "b", 0.55)],
                  "actual string, predicted string, probability double")
    got = {(r["class"], r.bin): r.n for r in ev.correct_calls(calls).collect()}
    assert got == {("a", 10): 2, ("b", 6): 1}
    assert ev.correct_call_quartiles(calls).filter("class = 'a'").first().n == 2


def test_quartiles_are_exact(frame):
    import numpy as np

    from cohortloom.operators import ranking

    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=301).round(1), "b": rng.random(50), "c": np.array([3.0]),
              "d": np.repeat([1.0, 2.0], [500, 1])}
    df = frame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)],
               "k string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.k, r.share): (r.value, r.n) for r in ranking.quantiles(df, ["k"], "v", shares).collect()}
    assert len(got) == len(values) * len(shares)
    for (k, share), (value, n) in got.items():
        assert value == pytest.approx(np.quantile(values[k], share), abs=1e-12) and n == len(values[k])
