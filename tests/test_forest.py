"""Shared forests against trees grown one by one, to their own limits."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evaluate, forest as fo, training as tr


def data(seed, n=60, of=6, classes=3):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, of)), 1)  # rounded, so that values tie
    x[:, -1] = 1.0  # a probe without variety
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=n) > 0).astype(int) + (x[:, 3] > 0.8) * (classes - 2)
    return x, y


def plain(x, y, w, classes, settings, place, depth, deepest, smallest):
    """A tree as nested tuples, one node after the other, with its limits tested on the way."""
    total = np.bincount(y, w, classes)
    number = fo.wanted_features(settings["max_features"], x.shape[1])
    if depth >= deepest or len(y) < smallest or (total > 0).sum() < 2:
        return total
    varied = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()]
    turn = {f: float(fo.mixed(place ^ fo.mixed(np.array([f + 1], np.uint64) * fo._MIX[0]))[0]) for f in varied}
    best = None
    for f in sorted(sorted(varied, key=turn.get)[:number]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            side = x[:, f] <= low
            if min(side.sum(), (~side).sum()) < settings["min_samples_leaf"]:
                continue
            gain = float(fo.gains(np.bincount(y[side], w[side], classes)[None], total[None], settings["criterion"])[0])
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, low + (high - low) / 2 if low + (high - low) / 2 < high else low
    if best is None:
        return total
    _, f, cut = best
    side = x[:, f] <= cut
    go = [fo.mixed(place * fo._MIX[0] + np.uint64(n)) for n in (1, 2)]
    return (f, cut, *(plain(x[s], y[s], w[s], classes, settings, g, depth + 1, deepest, smallest)
                      for s, g in ((side, go[0]), (~side, go[1]))))


def shares(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree / tree.sum()


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("number,least", [(None, 1), ("sqrt", 1), ("log2", 3)])
def test_cut_trees_are_the_trees_of_separate_fits(criterion, number, least):
    settings = {**fo.GROWN, "criterion": criterion, "max_features": number, "min_samples_leaf": least}
    cuts = [(fo.DEEPEST, 2), (3, 2), (fo.DEEPEST, 10), (2, 5)]
    for seed in range(4):
        x, y = data(seed)
        check, _ = data(seed + 50)
        w = np.random.default_rng(seed).integers(1, 4, len(y)).astype(float)
        key = fo.tree_key(seed, 7)
        tree = fo.grow(x, y, w, 3, settings, key)
        at = fo.cut_nodes(tree, cuts)[:, fo.leaves(tree, check)]
        for c, (deepest, smallest) in enumerate(cuts):
            want = plain(x, y, w, 3, settings, np.array([key], np.uint64), 0, deepest, smallest)
            got = tree.weights[at[c]] / tree.weights[at[c]].sum(axis=1, keepdims=True)
            assert np.allclose(got, [shares(want, r) for r in check])


def test_more_trees_go_on_from_fewer():
    x, y = data(1)
    check, _ = data(2)
    settings = {**fo.GROWN, "class_weight": "balanced"}
    vote = lambda r: fo.forest_votes(x, y, check, 3, settings, r, [(4, 2)], 5)
    assert np.allclose(vote(range(0, 4)) + vote(range(4, 9)), vote(range(0, 9)))
    assert np.allclose(vote(range(9)).sum(axis=2), 9)


@pytest.mark.parametrize("weight", [None, "balanced"])
@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_trees_grown_at_once_are_those_grown_one_by_one(criterion, weight, monkeypatch):
    settings = {**fo.GROWN, "criterion": criterion, "max_features": "sqrt", "class_weight": weight}
    x, y = data(4)
    together = list(fo.grown(x, y, 3, settings, range(2, 9), 5))
    monkeypatch.setattr(fo, "AT_ONCE", 1)
    alone = list(fo.grown(x, y, 3, settings, range(2, 9), 5))
    assert len(together) == 7 and len({len(t.depth) for t in together}) > 1
    assert all(np.array_equal(a, b) for one, other in zip(together, alone) for a, b in zip(one, other))


def test_one_class_one_row_and_no_rows():
    x, y = data(3)
    assert (fo.forest_votes(x, y * 0, x, 2, fo.GROWN, range(3), [(5, 2)], 1)[0, :, 0] == 3).all()
    assert fo.forest_votes(x[:1], y[:1], x, 3, fo.GROWN, range(2), [(5, 2)], 1).sum() == 2 * len(x)
    assert fo.forest_votes(x[:0], y[:0], x, 3, fo.GROWN, range(2), [(5, 2)], 1).sum() == 0


def test_grids_are_taken_apart():
    grid = fo.take_apart(tr.grid_points(tr.FOREST_GRID))
    assert (len(grid.points), len(grid.forests), len(grid.cuts), len(grid.blocks)) == (324, 12, 9, 3)
    grid = fo.take_apart(tr.grid_points(tr.AUC_FOREST_GRID))
    assert (len(grid.points), len(grid.forests), len(grid.cuts)) == (108, 3, 9)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data(4, 90)
    return spark.createDataFrame(
        [("n", i, f"c{c}", int(c), 3, i % 3, f, v.tolist()) for i, (v, c) in enumerate(zip(x, y)) for f in range(3)],
        "node_id string, sample_id int, cancer_type string, label int, classes int, fold int, train_of int, x array<double>")


def test_votes_of_all_points(rows):
    points = tr.grid_points({"n_estimators": [3, 8], "max_depth": [None, 2], "max_features": ["sqrt"]})
    got = {(r.fold, r.point, r.sample_id): r.votes for r in fo.votes(rows, fo.take_apart(points), 3, 11).collect()}
    x, y = data(4, 90)
    fold = np.arange(90) % 3
    assert len(got) == 4 * 90
    for n, p in enumerate(points):
        for f in range(3):
            want = fo.forest_votes(x[fold != f], y[fold != f], x[fold == f], 3, fo.settings_of(p),
                                   range(p["n_estimators"]), [fo.cut_of(p)], 11)[0]
            for i, w in zip(np.flatnonzero(fold == f), want):
                assert np.allclose(got[f, n, i], w)


def test_model_of_spark_votes_alike(spark, rows, tmp_path):
    some = rows.filter("train_of = 0").withColumn("v", F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("p"), i.cast("string"))), F.col("x")))
    ready = tr._labelled(some, ["c0", "c1", "c2"], [f"p{i}" for i in range(6)], 90)
    for point in ({"n_estimators": 30, "max_depth": 4, "criterion": "entropy", "min_samples_split": 5},
                  {"n_estimators": 7, "class_weight": "balanced"}):
        model = fo.model(some, ready, point, 3, str(tmp_path / str(len(point))))
        assert model.getNumTrees == point["n_estimators"] and model.featureImportances[5] == 0
        x, y = data(4, 90)
        want = fo.forest_votes(x, y, x, 3, fo.settings_of(point), range(point["n_estimators"]), [fo.cut_of(point)], 3)[0]
        got = {r.sample_id: r.probability for r in model.transform(ready).collect()}
        assert np.allclose([got[i].toArray() for i in range(90)], want / want.sum(axis=1, keepdims=True))


def test_areas_of_many_points_at_once(spark):
    draw = np.random.default_rng(5)
    calls = [(p, int(i), f"c{draw.integers(3)}", np.round(draw.random(3), 1).tolist()) for p in range(3) for i in range(40)]
    frame = spark.createDataFrame(calls, "point int, sample_id int, cancer_type string, votes array<double>")
    got = {r.point: r.score for r in tr.mean_areas(frame, ["c0", "c1", "c2"], ["point"]).collect()}
    for p in range(3):
        long = spark.createDataFrame([(c, f"c{n}", v) for q, _, c, vs in calls if q == p for n, v in enumerate(vs)],
                                     "actual string, class string, score double")
        want = evaluate.roc_auc(long).agg(F.avg("auc").alias("a")).first()["a"]
        assert got[p] == pytest.approx(want)


def test_outcomes_are_kept_and_a_run_goes_on(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(6)
    samples = spark.createDataFrame(
        [(n, i, "ab"[i % 2], i >= 24, None if i >= 24 else i // 2 % 3) for n in ("x", "y") for i in range(30)],
        "node_id string, sample_id int, cancer_type string, held_out boolean, fold int")
    probes = spark.createDataFrame([(n, f, f"p{j}") for n in ("x", "y") for f in (-1, 0, 1, 2) for j in range(3)],
                                   "node_id string, train_of int, probe_id string")
    matrix = spark.createDataFrame(
        [(n, i, f"p{j}", float(draw.normal() + (i % 2) * (j == 0))) for n in ("x", "y") for i in range(30) for j in range(3)],
        "node_id string, sample_id int, probe_id string, m_value double")
    plan, store = tr.SearchPlan(samples, probes, matrix), str(tmp_path)
    grid = {"n_estimators": [3, 5], "max_depth": [None, 1]}
    whole, search = tr.search, tr.search

    def broken(plan, node_id, *rest, **more):
        if node_id == "y":
            raise RuntimeError("lost")
        return search(plan, node_id, *rest, **more)

    monkeypatch.setattr(tr, "search", broken)
    first = tr.search_nodes(plan, "random_forest", grid, store=store)
    assert isinstance(first["y"], RuntimeError) and not isinstance(first["x"], Exception)
    asked = []
    monkeypatch.setattr(tr, "search", lambda p, n, *a, **k: asked.append(n) or whole(p, n, *a, **k))
    second = tr.search_nodes(plan, "random_forest", grid, store=store, names={"x": "X"})
    assert asked == ["y"] and second["x"].model.name == "X"
    assert second["x"].scores == first["x"].scores and second["x"].test_accuracy == first["x"].test_accuracy
    tr.search_nodes(plan, "random_forest", {**grid, "max_depth": [2]}, store=store)
    assert sorted(asked) == ["x", "y", "y"]
    maps = tr.value_maps(matrix.filter("node_id = 'x'"), ["p0", "p1", "p2"])
    calls = [{r.sample_id: (r.prediction, r.probability) for r in s["x"].model.transform(maps).collect()}
             for s in (first, second)]
    assert calls[0] == calls[1] and len(calls[0]) == 30


@pytest.mark.parametrize("number,least", [("sqrt", 2), (None, 1)])
def test_classes_that_fill_several_words(number, least):
    draw = np.random.default_rng(2)
    x, y = np.round(draw.normal(size=(120, 5)), 1), draw.integers(0, 9, 120)
    w = draw.integers(1, 200, 120).astype(float)  # 9 classes of more than 13 bits
    settings = {**fo.GROWN, "max_features": number, "min_samples_leaf": least}
    tree = fo.grow(x, y, w, 9, settings, fo.tree_key(1, 1))
    want = plain(x, y, w, 9, settings, np.array([fo.tree_key(1, 1)], np.uint64), 0, fo.DEEPEST, 2)
    got = tree.weights[fo.leaves(tree, x)]
    assert np.allclose(got / got.sum(axis=1, keepdims=True), [shares(want, r) for r in x])


def test_rows_are_sorted_for_the_probes_a_node_looks_at(monkeypatch):
    """Of 40 probes a node looks at six: not a seventh of the rows is weighed, or carried on in order, for all."""
    x = np.random.default_rng(3).normal(size=(400, 40))
    y = np.random.default_rng(4).integers(0, 2, 400)
    weighed, weigh = [], fo.weigh
    monkeypatch.setattr(fo, "weigh", lambda level, probes, nodes, *a: weighed.append(level.sizes[nodes].sum()) or
                        weigh(level, probes, nodes, *a))
    tree = fo.grow(x, y, np.ones(400), 2, {**fo.GROWN, "max_features": "sqrt"}, 5)
    inner = tree.samples[tree.left != np.arange(len(tree.depth))].sum()
    assert 0 < sum(weighed) <= 6 * inner


def test_large_numbers_of_ranks_are_sorted_by_place():
    draw = np.random.default_rng(5)
    own, rank, rows = draw.integers(0, 4, 50), draw.integers(0, 9, 50).astype(np.uint32), np.arange(50)
    for a, b in zip(fo.by_rank(own, rank, rows, 3, 4, 6), fo.by_rank(own, rank, rows, 3, 40, 40)):
        assert np.array_equal(a, b)


def test_forest_stays_in_storage(spark, rows, tmp_path):
    """What the driver holds does not grow with the trees; a stored forest votes as before."""
    some = rows.filter("train_of = 0").withColumn("v", F.map_from_arrays(F.array(*[F.lit(f"p{i}") for i in range(6)]), F.col("x")))
    names = [f"p{i}" for i in range(6)]
    ready = tr._labelled(some, ["c0", "c1", "c2"], names, 90)
    model = tr.NodeModel("n", names, ["c0", "c1", "c2"], fo.model(some, ready, {"n_estimators": 6}, 3, str(tmp_path / "f"), 2))
    assert len(pickle.dumps(model.stages.__dict__)) < 2000 and len(list((tmp_path / "f" / "trees").iterdir())) == 6
    model.save(spark, str(tmp_path / "m"))
    again = tr.load_model(spark, str(tmp_path / "m"))
    calls = [{r.sample_id: (r.prediction, r.probability, r.scores) for r in m.transform(some).collect()} for m in (model, again)]
    assert calls[0] == calls[1] and len(calls[0]) == 90 and again.stages.featureImportances == model.stages.featureImportances
