import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import dataset as ds, inference as inf, training as tr, tree

SMALL = {"n_estimators": [5], "max_depth": [3]}


@pytest.fixture(scope="module")
def level(spark):
    """100 samples x 20 features, two classes of 50 under one node; the first
    class is shifted in two features so that there is something to learn."""
    rng = np.random.default_rng(42)
    values = rng.random((100, 20))
    values[:50, :2] += 1.0
    m = spark.createDataFrame(
        [(f"s{i:03d}", f"feature{j}", float(v)) for i, row in enumerate(values)
         for j, v in enumerate(row)], "sample_id string, probe_id string, m_value double")
    edges = spark.createDataFrame([("top", "typeA", 0), ("top", "typeB", 1)],
                                  "parent string, child string, position int")
    held = spark.createDataFrame(
        [("typeA" if i < 50 else "typeB", f"s{i:03d}") for i in range(100)],
        "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, held, "top")
    return m, nodes, tree.node_samples(nodes, held)


@pytest.fixture(scope="module")
def planned(level):
    m, nodes, held = level
    return m, tr.plan_search(m, ds.node_design(m, nodes, held), k=2, number=5)


def test_unknown_model_type(level):
    m, nodes, held = level
    with pytest.raises(ValueError, match="Unsupported model type"):
        tr.model_grid("invalid_model")
    with pytest.raises(ValueError, match="Unsupported model type"):
        tr.train_tree(m, nodes, held, "invalid_model")


def test_grids():
    assert len(tr.grid_points(tr.FOREST_GRID)) == 324
    assert len(tr.grid_points(tr.SVM_GRID)) == 12


def test_plan_holds_out_a_fifth(planned):
    samples, probes = planned[1].samples, planned[1].probes
    rows = samples.collect()
    assert sum(r.held_out for r in rows) == 20 and len(rows) == 100
    assert {r.cancer_type for r in rows if r.held_out} == {"typeA", "typeB"}
    assert sorted(sum(r.fold == f for r in rows) for f in (0, 1)) == [40, 40]
    for train_of in (-1, 0, 1):
        chosen = {r.probe_id for r in probes.filter(F.col("train_of") == train_of).collect()}
        assert len(chosen) == 5 and {"feature0", "feature1"} <= chosen


def test_forest_search(planned):
    m, plan = planned
    found = tr.search(plan, "top", "random_forest", SMALL, k=2)
    assert found.best == {"n_estimators": 5, "max_depth": 3}
    assert (found.n_train, found.n_test) == (80, 20)
    assert found.test_accuracy > 0.8 and 0.0 <= found.scores[0]["score"] <= 1.0
    weights = {r.probe_id: r.importance for r in tr.importances(m.sparkSession,
                                                                {"top": found.model}).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert weights.get("feature0", 0) + weights.get("feature1", 0) > 0.5


def test_svm_search(planned):
    m, plan = planned
    found = tr.search(plan, "top", "svm", {"C": [0.1, 1.0], "max_iter": [20]}, k=2)
    assert len(found.scores) == 2 and found.test_accuracy > 0.8


def test_scaling_uses_the_population_deviation(level):
    m, _, _ = level
    rows = tr.value_maps(m, ["feature0", "feature5"]).withColumn(
        "features", tr.vector_of("v", ["feature0", "feature5"])).orderBy("sample_id")
    out = rows
    for stage in tr.population_scaler(rows, 100):
        out = stage.transform(out)
    got = np.array([r.scaled.toArray() for r in out.collect()])
    assert got.mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    assert got.std(axis=0) == pytest.approx([1, 1], rel=1e-9)


def test_train_tree_saves_models(level, spark, tmp_path):
    m, nodes, held = level
    models, stats = tr.train_tree(m, nodes, held, "random_forest", SMALL, str(tmp_path), number=5)
    got = {r.name: r for r in stats.collect()}
    assert got["top"].status == "trained" and got["top"].n_features == 5
    assert got["typeA"].status == "skipped" and set(models) == {"top"}
    assert tr.training_summary(stats).count() == 1
    again = tr.load_model(spark, str(tmp_path / "top"))
    rows = tr.value_maps(m, again.features)
    assert again.transform(rows).select("sample_id", "prediction").orderBy("sample_id").collect() \
        == models["top"].transform(rows).select("sample_id", "prediction").orderBy("sample_id") \
        .collect()


def test_too_few_samples_train_nothing(level, spark):
    m, _, _ = level
    edges = spark.createDataFrame([("top", "a", 0), ("top", "b", 1)],
                                  "parent string, child string, position int")
    held = spark.createDataFrame([("a", "x1"), ("a", "x2"), ("b", "x3")],
                                 "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, held, "top")
    models, stats = tr.train_tree(m, nodes, tree.node_samples(nodes, held), "random_forest", SMALL)
    assert models == {} and {r.status for r in stats.collect()} == {"skipped"}


def test_refit_records_errors(level, spark):
    m, nodes, held = level
    records = spark.createDataFrame(
        [("top", "RandomForestClassifier", {"n_estimators": "3", "max_depth": "None"},
          ["feature0", "feature1", "feature2", "unknown"]),
         ("typeA", "SVC", {}, ["feature0"])],
        "model_name string, model_type string, parameters map<string,string>, "
        "feature_names array<string>")
    models, status = tr.refit(m, nodes, held, records)
    got = {r.model: r for r in status.collect()}
    assert got["top"].status == "fitted" and got["top"].n_features == 3
    assert got["top"].n_samples == 100 and got["typeA"].status == "failed"
    assert models["top"].params == {"n_estimators": 3, "max_depth": None}


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_sums_to_one(planned, method):
    m, plan = planned
    found = tr.search(plan, "top", "random_forest", SMALL, k=2)
    labels = plan.samples.filter("not held_out").select("sample_id", "cancer_type")
    scored = inf.validation_calls(m, found.model, labels).withColumnRenamed("actual", "cancer_type")
    out = tr.calibrate(scored, found.model.labels, method).collect()
    assert len(out) == 80
    for r in out:
        assert sum(r.calibrated) == pytest.approx(1.0) and min(r.calibrated) >= 0
    with pytest.raises(ValueError):
        tr.calibrate(scored, found.model.labels, "other")


@pytest.fixture(scope="module")
def three_levels(spark):
    """top -> a, b; a -> a (its own name again), a2.  Features separate the classes."""
    rng = np.random.default_rng(7)
    rows, held = [], []
    for i in range(60):
        kind = ("b", "a1", "a2")[i % 3]
        f = [3.0 * (kind == "b"), 3.0 * (kind == "a2"), 0.0] + rng.normal(0, 0.1, 3)
        rows += [(f"s{i}", f"f{j}", float(v)) for j, v in enumerate(f)]
        held.append((kind, f"s{i}"))
    m = spark.createDataFrame(rows, "sample_id string, probe_id string, m_value double")
    edges = spark.createDataFrame(
        [("top", "a", 0), ("top", "b", 1), ("a", "a1", 0), ("a", "a2", 1)],
        "parent string, child string, position int")
    samples = spark.createDataFrame(held, "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, samples, "top")
    records = spark.createDataFrame(
        [(n, "random_forest", {"n_estimators": "5", "max_depth": "3"}, ["f0", "f1", "f2"])
         for n in ("top", "a")],
        "model_name string, model_type string, parameters map<string,string>, "
        "feature_names array<string>")
    node_samples = tree.node_samples(nodes, samples)
    models, _ = tr.refit(m, nodes, node_samples, records)
    return m, nodes, node_samples, models, dict((s, k) for k, s in held)


def test_prediction_goes_down_the_tree(three_levels, spark):
    m, nodes, held, models, truth = three_levels
    out = inf.predict_tree(m, models, "top")
    by_sample = {}
    for r in out.collect():
        by_sample.setdefault(r.sample_id, {})[r.depth] = r
        assert 0.0 <= r.probability <= 1.0
    wrong = 0
    for sample, kind in truth.items():
        levels = by_sample[sample]
        # A sample goes on exactly when its class names a model.
        assert set(levels) == ({1, 2} if levels[1].prediction == "a" else {1})
        assert all(levels[d].model == n for d, n in zip(sorted(levels), ("top", "a")))
        wrong += levels[max(levels)].prediction != kind
    assert wrong <= 3
    asked = spark.createDataFrame([("s0",), ("s1",), ("zz",)], "sample_id string")
    final = {r.sample_id: r.prediction
             for r in inf.final_predictions(out, asked, models, "top").collect()}
    deepest = {s: by_sample[s][max(by_sample[s])].prediction for s in ("s0", "s1")}
    assert final == {**deepest, "zz": None}
    known, unknown = inf.requested(m, asked)
    assert known.count() == 2 and [r.sample_id for r in unknown.collect()] == ["zz"]
    nested = {r.sample_id: r.predictions for r in inf.nested(out).collect()}
    assert nested["s1"]["top"]["prediction"] == by_sample["s1"][1].prediction


def test_missing_root_model_answers_its_name(three_levels, spark):
    m, _, _, models, _ = three_levels
    asked = spark.createDataFrame([("s0",)], "sample_id string")
    none = inf.predict_tree(m, models, "elsewhere", asked)
    assert none.count() == 0
    assert inf.final_predictions(none, asked, models, "elsewhere").first().prediction == "elsewhere"


def test_embedding_and_projection(three_levels, spark):
    m, nodes, held, models, truth = three_levels
    weights = spark.createDataFrame([("top", f"f{i}", 0.5) for i in range(3)] + [("top", "f9", 0.0)],
                                    "model string, probe_id string, importance double")
    first = held.filter("sample_id <> 's4'")
    fitted = tr.fit_embedding(m, first, weights, "top")
    placed = tr.embed(fitted, m.join(first.select("sample_id"), "sample_id", "left_semi"))
    assert placed.count() == 59
    gappy = m.filter("not (sample_id = 's4' and probe_id = 'f2')")
    wanted = held.select("sample_id").union(spark.createDataFrame([("nobody",)], "s string"))
    full, lost = tr.project_missing(fitted, placed, gappy, wanted)
    assert full.count() == 60 and [r.sample_id for r in lost.collect()] == ["nobody"]
    labels = tree.labels_at_level(nodes, held, 2)
    new = full.filter("sample_id = 's4'").withColumn("cancer_type", F.lit("guess"))
    plot = tr.plot_table(placed, labels, new)
    centres = {r.cancer_type: r for r in tr.class_centroids(plot).collect()}
    assert set(centres) == {"a", "b", "guess"} and centres["guess"].y_range == 0.0
    gap = math.dist((centres["a"].x, centres["a"].y), (centres["b"].x, centres["b"].y))
    assert gap > 1.0


def test_binary_call_includes_the_threshold(spark):
    scored = spark.createDataFrame([(0.5,), (0.49,)], "probability double")
    assert [r.call for r in inf.binary_call(scored).collect()] == [1, 0]
