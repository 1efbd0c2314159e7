"""Machines against the conditions of their optimum, and landmarks against the exact kernel."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation, functions as F

from cohortloom.operators import svm, training as tr


def level():
    """100 samples x 20 probes, two classes; the first is shifted in two probes."""
    values = np.random.default_rng(42).random((100, 20))
    values[:50, :2] += 0.4
    return values, np.repeat([0, 1], 50)


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_optimum(c):
    """Every sample keeps its side of the margin as its coefficient says."""
    x, y = level()
    x, s = (x - x.mean(0)) / x.std(0), np.where(y == 0, 1.0, -1.0)
    for settings in ({"kernel": "linear"}, {"kernel": "rbf"}):
        k = svm.kernel(x, x, settings, 0.05)
        a, bias, rested = svm.solve(k, s, c)
        margin, size = s * (k @ a + bias), a * s
        assert rested and abs(a.sum()) < 1e-6 * c and size.min() >= 0 and size.max() <= c
        slack = 5 * svm.TOLERANCE
        assert (margin[size == 0] >= 1 - slack).all() and (margin[size == c] <= 1 + slack).all()
        assert np.allclose(margin[(size > 0) & (size < c)], 1, atol=slack)
    weights, bias, rested = svm.solve_linear(x, s, c)
    a, other, _ = svm.solve(x @ x.T, s, c)
    assert rested and np.allclose(weights, x.T @ a, atol=0.02 * np.abs(weights).max()) and abs(bias - other) < 0.02


def test_hard_linear_problem_comes_to_rest():
    draw = np.random.default_rng(0)
    machine = svm.fit(draw.normal(size=(300, 40)), draw.integers(0, 3, 300), 3, {"C": 10, "kernel": "linear", "gamma": None})
    assert machine.rested and machine.vectors.shape == (3, 40)


def test_pairs_vote_and_ties_go_to_the_first():
    machine = svm.Machine(np.zeros(1), np.ones(1), {"kernel": "linear"}, 0.0, np.array([[1.0], [-1.0], [1.0]]),
                          [(0, 1), (0, 2), (1, 2)], np.eye(3), np.zeros(3), 3, True)
    assert machine.predict(np.array([[1.0]])).tolist() == [0]  # one vote each


def test_widths():
    x = np.random.default_rng(1).normal(size=(50, 4))
    assert svm.width_of("auto", x) == 0.25 and svm.width_of("scale", x) == pytest.approx(1 / (4 * x.var()))
    assert svm.width_of(0.5, x) == 0.5 and svm.width_of("scale", x * 0) == 1.0
    with pytest.raises(ValueError, match="Unsupported kernel"):
        svm.kernel(x, x, {"kernel": "poly"}, 1.0)


def test_grid_shares_linear_machines(spark):
    x, y = level()
    rows = spark.createDataFrame(
        [("n", i, "ab"[c], int(c), 2, i % 3, f, v.tolist()) for i, (v, c) in enumerate(zip(x, y)) for f in range(3)],
        "node_id string, sample_id int, cancer_type string, label int, classes int, fold int, train_of int, x array<double>")
    points = tr.grid_points(tr.SVM_GRID)
    got = svm.calls(rows, points, 3).collect()
    assert len(got) == 12 * 100
    fold = np.arange(100) % 3
    for n in (0, 3, 10):
        called = {r.sample_id: r.called for r in got if r.point == n}
        for f in range(3):
            want = svm.fit(x[fold != f], y[fold != f], 2, svm.settings_of(points[n])).predict(x[fold == f])
            assert [called[i] for i in np.flatnonzero(fold == f)] == want.tolist()


def test_landmarks_are_near_the_kernel(spark):
    """All samples as landmarks give the exact kernel; half of them come within 0.25 of its values."""
    x, _ = level()
    x = (x - x.mean(0)) / x.std(0)
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["sample_id", "scaled"])
    exact = svm.kernel(x, x, {"kernel": "rbf"}, 0.05)
    for number, error in ((100, 1e-6), (50, 0.25)):
        marks = svm.landmarks(rows, {"kernel": "rbf", "gamma": 0.05}, number)
        assert len(marks.vectors) == number
        mapped = np.array([r.mapped.toArray() for r in marks.transform(rows).orderBy("sample_id").collect()])
        away = np.abs(mapped @ mapped.T - exact)
        assert away[~np.eye(100, dtype=bool)].max() < error


def test_beyond_the_bound_landmarks_and_spark_do_it(spark, tmp_path):
    """Decision values within 0.15 of the exact machine's; what is kept of the training is gone."""
    x, y = level()
    train = spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))],
                                  ["sample_id", "features", "label"])
    point = {"C": 1.0, "kernel": "rbf", "gamma": "auto"}
    mapped, rested = tr._fit(train, "svm", point, 2, 100, 1)
    exact = svm.fit(x, y, 2, svm.settings_of(point))
    assert rested and not mapped.last.stages[-1].hasSummary
    seen = Observation("n")  # an observed job in the session must not break scoring
    train.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 100
    mapped.save(spark, str(tmp_path / "m"))
    for model in (mapped, svm.load_mapped(spark, str(tmp_path / "m"))):
        rows = model.transform(train).orderBy("sample_id").collect()
        values = np.array([r.rawPrediction[1] for r in rows])
        assert np.abs(values + exact.decisions(x)[:, 0]).max() < 0.15
        sure = np.abs(values) > 0.15
        assert (np.array([r.prediction for r in rows]) == exact.predict(x))[sure].all() and sure.mean() > 0.9


def test_machine_is_stored(spark, tmp_path):
    x, y = level()
    machine = svm.fit(x, y, 2, svm.settings_of({"kernel": "rbf"}))
    machine.save(spark, str(tmp_path))
    again = svm.load(spark, str(tmp_path))
    assert np.allclose(again.decisions(x), machine.decisions(x)) and again.rested


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_mapped_machines_are_the_optimum(monkeypatch, classes, kernel):
    """A machine per class against the rest on the coordinates of the landmarks, as the pairwise solver finds it."""
    monkeypatch.setattr(svm, "LANDMARKS", 60)
    draw = np.random.default_rng(8)
    y, order = draw.integers(0, classes, 150), draw.permutation(150)
    x = draw.normal(size=(150, 8)) + 1.5 * np.eye(8)[y]
    settings = svm.settings_of({"kernel": kernel})
    ours = svm.fit_mapped(x, y, classes, settings, order)
    z = (x - x.mean(0)) / x.std(0)
    z = z if kernel == "linear" else svm.Landmarks.of(z[order[:60]], settings).map(z)
    found = [svm.solve(z @ z.T, np.where(y == c, 1.0, -1.0), 1.0) for c in ([1] if classes == 2 else range(classes))]
    want = np.stack([z @ (z.T @ a) + bias for a, bias, _ in found], axis=1)
    got = ours.decisions(x)
    assert ours.rested and got.shape == want.shape and np.abs(got - want).max() < 0.02
    called = (got[:, 0] > 0).astype(int) if classes == 2 else got.argmax(axis=1)
    assert (ours.predict(x) == called).all() and (called == y).mean() > 0.6


def test_class_without_samples_is_never_called():
    x, y = level()
    machine = svm.fit_mapped(x, y, 3, svm.settings_of({"kernel": "linear"}), np.arange(100))
    assert machine.decisions(x)[:, 2].tolist() == [-1.0] * 100 and set(machine.predict(x)) == {0, 1}
    alone = svm.fit_mapped(x, y * 0, 3, svm.settings_of({"kernel": "rbf"}), np.arange(100))
    assert alone.predict(x).tolist() == [0] * 100


def test_beyond_the_kernel_a_search_is_solved_in_tasks(spark, monkeypatch, tmp_path):
    """No step of any machine is a Spark job; the mapped machine is stored and scores as before."""
    monkeypatch.setattr(svm, "KERNEL_BYTES", 0)
    monkeypatch.setattr(tr, "_fit", lambda *_: pytest.fail("fitted by Spark ML"))
    x, y = level()
    m = spark.createDataFrame([(i, f"p{j:02d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)],
                              "sample_id int, probe_id string, m_value double")
    design = spark.createDataFrame([("n", i, "ab"[c]) for i, c in enumerate(y)],
                                   "node_id string, sample_id int, cancer_type string")
    found = tr.search(tr.plan_search(m, design, prior="none", number=5), "n", "svm", {"C": [1.0], "kernel": ["linear", "rbf"]})
    assert found.model.stages.pairs == [(1, 0)] and min(s["score"] for s in found.scores) > 0.7
    assert found.rested and found.test_accuracy > 0.6
    found.model.save(spark, str(tmp_path / "m"))
    again = tr.load_model(spark, str(tmp_path / "m")).stages
    assert np.allclose(again.decisions(x[:, :5]), found.model.stages.decisions(x[:, :5]))


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_no_size_asks_for_another_machine(monkeypatch, c):
    """A kernel matrix that is not held gives the same machine, of pairs of classes, not one by landmarks."""
    assert svm.KERNEL_BYTES is None
    draw = np.random.default_rng(9)
    y = draw.integers(0, 3, 240)
    x = draw.normal(size=(240, 6)) + np.eye(6)[y]
    settings = {"C": c, "kernel": "rbf", "gamma": "scale"}
    whole = svm.fit(x, y, 3, settings)
    monkeypatch.setattr(svm, "HELD_BYTES", 4096)
    monkeypatch.setattr(svm, "WORKING", 24)
    monkeypatch.setattr(svm, "solve", lambda *_: pytest.fail("the whole kernel matrix"))
    parts = svm.fit(x, y, 3, settings)
    assert parts.rested and parts.pairs == whole.pairs == [(0, 1), (0, 2), (1, 2)]
    assert np.abs(parts.decisions(x) - whole.decisions(x)).max() < 10 * svm.TOLERANCE


def test_large_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(svm, "HELD_BYTES", 4096)
    monkeypatch.setattr(svm, "fit_mapped", lambda *_: pytest.fail("landmarks"))
    monkeypatch.setattr(tr, "_fit", lambda *_: pytest.fail("fitted by Spark ML"))
    x, y = level()
    m = spark.createDataFrame([(i, f"p{j:02d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)],
                              "sample_id int, probe_id string, m_value double")
    design = spark.createDataFrame([("n", i, "ab"[c]) for i, c in enumerate(y)],
                                   "node_id string, sample_id int, cancer_type string")
    found = tr.search(tr.plan_search(m, design, prior="none", number=5), "n", "svm", {"C": [1.0], "kernel": ["rbf"]})
    assert found.model.stages.pairs == [(0, 1)] and found.rested
