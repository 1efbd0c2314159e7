"""The registered model queries search every trainable node on the operators' defaults."""

from types import SimpleNamespace

import numpy as np

from cohortloom.operators import training as tr
from cohortloom.plans import models, samples

SF = "/root/testdata/sf0.001"


def test_search_is_whole(spark, monkeypatch, tmp_path):
    asked = []

    def search(plan, node_id, model_type="svm", grid=None, *rest):
        asked.append((node_id, model_type, grid))
        return SimpleNamespace(scores=[{"score": 1.0}], n_train=1, n_test=1, test_accuracy=1.0,
                               model=SimpleNamespace(name=""))

    monkeypatch.setattr(tr, "search", search)
    monkeypatch.setattr(tr, "save_outcome", lambda *_: None)
    monkeypatch.setattr(models, "_store", lambda *_: str(tmp_path))
    got = {r.node_id for r in models.forest_cv(spark, SF).collect()}
    assert got == {r.node_id for r in models.train_gaps(spark, SF).collect()} and len(got) > 1
    assert all(x[1:] == ("random_forest", tr.FOREST_GRID) for x in asked)


def test_selected_matrix_has_no_gaps(spark):
    got = samples.diff_selected_matrix(spark, SF)
    assert got.filter("m_value IS NULL").count() == 0 and got.select("probe_id").distinct().count() > 10


def test_samples_with_gaps_are_filled_and_projected(spark, tmp_path, monkeypatch):
    """The embedding has probes with gaps; their samples come after the complete ones, and none is lost."""
    draw = np.random.default_rng(3)
    values = draw.normal(size=(60, 64)) + np.eye(64)[np.arange(60) % 6] * 3
    spark.createDataFrame([(i, v.tolist(), i % 6) for i, v in enumerate(values)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, project = {}, tr.project_missing

    def watched(fitted, placed, m, wanted):
        seen.update(placed=placed.count(), features=set(fitted.features))
        return project(fitted, placed, m, wanted)

    monkeypatch.setattr(tr, "project_missing", watched)
    got = models.project_missing(spark, str(tmp_path))
    gaps = {i for i in range(60) for p in range(0, 64, 3) if (i * 7 + p) % 97 == 0}
    assert gaps and seen["placed"] == 60 - len(gaps)
    assert any(int(f[1:]) % 3 == 0 for f in seen["features"])
    assert sorted(r.sample_id for r in got.collect()) == list(range(60))
