"""Nothing is lost to missing values: every sample is fitted on, scored, or listed."""

import pytest
from pyspark.sql import SparkSession

from cohortloom import session
from cohortloom.operators import dataset as ds, inference as inf, qc, training as tr, tree

IDS = [f"s{i:02d}" for i in range(60)]
SMALL = {"n_estimators": [5], "max_depth": [3]}


@pytest.fixture(scope="module")
def gappy(frame):
    """Two classes, six probes; p5 is null for one sample and p4 absent for another."""
    rows = [(s, f"p{p}", (1.0 if i % 2 else -1.0) * (p + 1) + (i * 7 + p * 3) % 5 / 10)
            for i, s in enumerate(IDS) for p in range(6)]
    rows = [(s, p, None if (s, p) == ("s07", "p5") else v) for s, p, v in rows if (s, p) != ("s11", "p4")]
    # A repeat of another cell must not stand in for the absent one.
    rows.append(("s12", "p4", 1.0))
    edges = frame([("top", "a"), ("top", "b")], "parent string, child string")
    held = frame([(s, "a" if i % 2 else "b") for i, s in enumerate(IDS)], "sample_id string, disease_name string")
    nodes = tree.build_tree(edges, held, "top")
    return frame(rows, "sample_id string, probe_id string, m_value double"), nodes, tree.node_samples(nodes, held)


def test_repeats_do_not_hide_gaps(gappy, rows):
    m = gappy[0]
    assert rows(qc.complete_probes(m)) == [("p0",), ("p1",), ("p2",), ("p3",)]
    assert {s for s, in rows(qc.complete_samples(m))} == set(IDS) - {"s07", "s11"}
    lacking = {r.sample_id: r.n_missing for r in qc.missing_per_sample(m, True).collect() if r.n_missing}
    assert lacking == {"s07": 1, "s11": 1}


def test_search_fits_on_every_sample(gappy):
    m, nodes, held = gappy
    design = ds.node_design(m, nodes, held, min_class=5, min_samples=10)
    plan = tr.plan_search(m, design, k=2, prior="none", number=6)
    assert {r.probe_id for r in plan.probes.collect()} <= {"p0", "p1", "p2", "p3"}
    found = tr.search(plan, "top", "random_forest", SMALL, k=2)
    assert found.n_train + found.n_test == len(IDS)
    size = tr.training_size(m, design).first()
    assert (size.n_samples, size.n_probes) == (len(IDS), 4)


def test_refit_counts_what_it_fits(gappy, frame):
    m, nodes, held = gappy
    records = frame([("top", kind, {"n_estimators": "5", "C": "0.5"}, [f"p{i}" for i in range(7)])
                     for kind in ("RandomForestClassifier", "LinearSVC", "other")],
                    "model_name string, model_type string, parameters map<string,string>, "
                    "feature_names array<string>")
    status = tr.refit(m, nodes, held, records)[1].collect()
    assert [(r.status, r.n_samples, r.n_features) for r in status] == [
        ("fitted", 60, 4), ("fitted", 60, 4), ("failed", None, None)]


def test_a_large_refit_grows_its_trees_in_tasks(gappy, frame, monkeypatch):
    m, nodes, held = gappy
    records = frame([("top", "RandomForestClassifier", {"n_estimators": "9", "max_features": "sqrt"},
                      [f"p{i}" for i in range(7)])],
                    "model_name string, model_type string, parameters map<string,string>, "
                    "feature_names array<string>")
    monkeypatch.setattr(tr, "SPARK_ML_BYTES", 0, raising=False)
    monkeypatch.setattr(tr, "_fit", lambda *_: 1 / 0)  # Spark ML's histograms are for small data
    models, status = tr.refit(m, nodes, held, records)
    assert [(r.status, r.n_samples, r.n_features, r.error) for r in status.collect()] == [("fitted", 60, 4, None)]
    model = models["top"].stages.stages[-1]
    assert model.getNumTrees == 9 and all(t.depth >= 1 for t in model.trees)
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_every_sample_is_scored_or_listed(gappy):
    m = gappy[0]
    models = {"top": Rule(["p0", "p5"], ["low", "z"]), "low": Rule(["p4"], ["x", "y"])}
    out = inf.predict_tree(m, models, "top")
    lost = {(r.sample_id, r.model): r.missing for r in inf.not_scored(m, out, models, "top").collect()}
    scored = {(r.sample_id, r.model) for r in out.collect()}
    assert {s for s, model in scored | set(lost) if model == "top"} == set(IDS)
    assert lost[("s07", "top")] == ["p5"] and not scored & set(lost)
    assert ("s11", "low") not in scored and (("s11", "low") in lost) == (("s11", "top") in scored
                                                                       and 11 % 2 == 1)


class Rule:
    """A model without training."""

    def __init__(self, features, labels):
        self.features, self.labels = features, labels

    def transform(self, rows, values="v"):
        from pyspark.sql import functions as F

        cells = [F.try_element_at(F.col(values), F.lit(p)) for p in self.features]
        total = sum(cells[1:], cells[0])
        out = F.when(total > 0, self.labels[0]).otherwise(self.labels[1])
        return rows.filter(total.isNotNull()).select(
            *rows.columns, out.alias("prediction"), F.lit(1.0).alias("probability"),
            F.lit(None).cast("array<double>").alias("scores"))


class Cluster:
    """As much of a session as is asked for the shared folder."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.made = master, None

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


@pytest.mark.parametrize("master", ["yarn", "spark://h:1", "local-cluster[2,1,512]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Cluster(master))
    assert session.checkpoint_root(Cluster(master, "hdfs:///x")) == "hdfs:///x"


def test_written_tables_go(spark: SparkSession, tmp_path):
    folder = tmp_path / "cohortloom-app"
    spark.range(3).write.parquet(str(folder / "t"))
    session.discard(spark, str(folder))
    assert not folder.exists()
    assert session.scratch_path(spark, "x").startswith(session.application_root(spark))
