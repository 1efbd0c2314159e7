"""Training one classifier per tree node.

Probe selection needs the whole long matrix; it is done for all nodes, all
folds and the final refit in one aggregate.  What is left per node, a few
hundred probes of its samples, is turned into vectors and given to Spark ML.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut, scratch_path, written
from . import dataset as ds, differential as dm, evaluate, forest, impute, qc, svm, tree

# The search grids.
SVM_GRID = {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]}
FOREST_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [None, 10, 20],
    "criterion": ["gini", "entropy"],
    "max_features": [None, "sqrt", "log2"],
    "min_samples_split": [2, 5, 10],
    "class_weight": [None, "balanced"],
}
AUC_FOREST_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
}
MODEL_GRIDS = {"svm": SVM_GRID, "random_forest": FOREST_GRID}
# Names that parameter records give the models.
RECORD_TYPES = {"RandomForestClassifier": "random_forest", "random_forest": "random_forest",
                "SVC": "svm", "LinearSVC": "svm", "svm": "svm"}
# Spark grows no deeper trees; a depth of none means this.
DEEPEST = 30
# Candidate splits of a continuous probe, whatever the number of samples.
MAX_BINS = 256
# Steps after which a linear machine that still moves counts as not converged.
MAX_ITER = 1000
PARTITION_BYTES = 32 << 20
# Trials of one node, and nodes, that are kept going at once.
WORKERS, NODE_WORKERS = 10, 4
# Bytes of vectors beyond which a refit's trees are grown in tasks: Spark ML passes over all rows for
# every few thousand nodes, each with a histogram of all bins, and a deep tree's nodes grow with the rows.
SPARK_ML_BYTES = 4 << 20
# Trees of such a forest that one task grows.
TOGETHER = 4


def model_grid(model_type: str) -> dict:
    if model_type not in MODEL_GRIDS:
        raise ValueError(f"Unsupported model type: {model_type}. "
                         f"Supported types are: {list(MODEL_GRIDS)}")
    return MODEL_GRIDS[model_type]


def grid_points(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


@dataclass
class NodeModel:
    """A fitted classifier with the probes and labels it was fitted on."""

    name: str
    features: list[str]
    labels: list[str]
    stages: PipelineModel | svm.Machine | svm.Mapped | forest.Forest
    params: dict = field(default_factory=dict)

    def transform(self, rows: DataFrame, values: str = "v") -> DataFrame:
        """Score rows that carry a probe -> value map; incomplete rows are left out.

        Adds ``prediction`` (a label), ``probability`` (of that label) and
        ``scores`` (one per label, null for models without probabilities).
        """
        ready = rows.withColumn("features", vector_of(values, self.features)).filter(
            F.col("features").isNotNull())
        out = self.stages.transform(ready)
        names = F.array(*[F.lit(c) for c in self.labels])
        scores = vector_to_array("probability") if "probability" in out.columns else \
            F.lit(None).cast("array<double>")
        return out.select(
            *rows.columns, F.get(names, F.col("prediction").cast("int")).alias("prediction"),
            F.get(scores, F.col("prediction").cast("int")).alias("probability"),
            scores.alias("scores"))

    def save(self, spark: SparkSession, path: str) -> None:
        if isinstance(self.stages, PipelineModel):
            self.stages.write().overwrite().save(f"{path}/stages")
        else:
            self.stages.save(spark, f"{path}/stages")
        spark.createDataFrame(
            [(self.name, self.features, self.labels, json.dumps(self.params), type(self.stages).__name__)],
            "name string, features array<string>, labels array<string>, params string, kind string",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> NodeModel:
    row = spark.read.parquet(f"{path}/model").first()
    loaders = {"Machine": svm.load, "Mapped": svm.load_mapped, "Forest": forest.load}
    stages = loaders[row["kind"]](spark, f"{path}/stages") if row["kind"] in loaders else \
        PipelineModel.load(f"{path}/stages")
    return NodeModel(row["name"], row["features"], row["labels"], stages, json.loads(row["params"]))


def vector_of(values: str, features: list[str]):
    """ML vector of the named probes out of a map column; null if any is missing."""
    wanted = F.array(*[F.lit(f) for f in features])
    cells = F.transform(wanted, lambda p: F.try_element_at(F.col(values), p))
    whole = F.forall(cells, lambda c: c.isNotNull())
    return F.when(whole, array_to_vector(F.when(whole, cells)))


def value_maps(m: DataFrame, features: list[str]) -> DataFrame:
    """(sample_id, v): probe -> value maps of the named probes only."""
    return impute.unique_cells(m, features).groupBy("sample_id").agg(F.map_from_entries(
            F.collect_list(F.struct("probe_id", "m_value"))).alias("v"))


def population_scaler(train: DataFrame, n: int) -> list:
    """Centre and divide by the population deviation (Spark's own divides by the sample's)."""
    base = StandardScaler(inputCol="features", outputCol="centred", withMean=True).fit(train)
    size = train.first()["features"].size
    grow = ElementwiseProduct(inputCol="centred", outputCol="scaled",
                              scalingVec=Vectors.dense([math.sqrt(n / max(n - 1, 1))] * size))
    return [base, grow]


def _fit(train: DataFrame, model_type: str, params: dict, n_labels: int, n: int,
         seed: int) -> tuple[PipelineModel | svm.Mapped, bool]:
    """(the model, whether it came to rest) of one grid point on (sample_id, features, label, weight) rows."""
    if model_type == "svm":
        kernel, column, mapped = svm.settings_of(params), "scaled", None
        scaling = population_scaler(train, n)
        scaled = PipelineModel(scaling).transform(train)
        if kernel["kernel"] != "linear":
            column, mapped = "mapped", svm.landmarks(scaled, kernel)
            scaled = mapped.transform(scaled).persist()
        machine = LinearSVC(featuresCol=column, regParam=1.0 / (params.get("C", 1.0) * n),
                            standardization=False, maxIter=params.get("max_iter", MAX_ITER))
        fitted = (machine if n_labels == 2 else OneVsRest(
            classifier=machine, featuresCol=column, parallelism=n_labels)).fit(scaled)
        rested = _rested(fitted, params.get("max_iter", MAX_ITER))
        if mapped is None:
            return PipelineModel([*scaling, fitted]), rested
        scaled.unpersist()
        return svm.Mapped(PipelineModel(scaling), mapped, PipelineModel([fitted])), rested
    if model_type == "random_forest":
        forest_ = RandomForestClassifier(
            featuresCol="features", seed=seed, numTrees=int(params.get("n_estimators", 100)),
            maxDepth=int(params.get("max_depth") or DEEPEST),
            impurity=params.get("criterion", "gini"),
            featureSubsetStrategy=params.get("max_features") or "all",
            # The nearest to "split nodes of at least s samples": s // 2 on each side.
            minInstancesPerNode=max(int(params.get("min_samples_leaf", 1)),
                                    int(params.get("min_samples_split", 2)) // 2),
            maxBins=int(params.get("max_bins", MAX_BINS)))
        if params.get("class_weight") == "balanced":
            forest_ = forest_.setWeightCol("weight")
        fitted = forest_.fit(train)
        _rested(fitted, 0)
        return PipelineModel([fitted]), True
    raise ValueError(f"Unsupported model type: {model_type}")


def _rested(model, steps: int) -> bool:
    """Whether every linear machine came to rest before its last step.

    What Spark ML keeps of the training, which holds the session and its
    listeners, is let go: it would be sent with every task that scores.
    """
    rested = True
    for one in getattr(model, "models", [model]):
        if one.hasSummary:
            rested &= not isinstance(one, LinearSVCModel) or one.summary().totalIterations < steps
            one._java_obj.setSummary(one._java_obj.getClass().getClassLoader().loadClass("scala.None$")
                                     .getField("MODULE$").get(None))
    return rested


def _labelled(rows: DataFrame, labels: list[str], features: list[str], n: int,
              weighted: bool = False) -> DataFrame:
    """Vectors with a label index and, if asked for, the weight n / (classes * n_class).

    The index carries the number of classes, so that no learner has to count
    them.  About ``n`` rows are spread over as many partitions as their size
    asks for: each step of a learner is a job over all of them.
    """
    index = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("cancer_type")) - 1
    about = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": len(labels)}}
    ready = rows.select("sample_id", "cancer_type",
                        index.cast("double").alias("label", metadata=about),
                        vector_of("v", features).alias("features")).filter(
        F.col("features").isNotNull())
    parts = max(1, math.ceil(n * len(features) * 8 / PARTITION_BYTES))
    if not weighted:
        return ready.coalesce(parts)
    sizes = ready.groupBy("cancer_type").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("n")).scalar()
    weights = sizes.select("cancer_type", (total / (len(labels) * F.col("_n"))).alias("weight"))
    return ready.join(weights, "cancer_type").coalesce(parts)


def accuracy(calls: DataFrame) -> float:
    right = F.avg((F.col("prediction") == F.col("cancer_type")).cast("double"))
    return float(calls.agg(right.alias("a")).first()["a"] or 0.0)


def mean_auc(calls: DataFrame, labels: list[str]) -> float:
    """One-vs-rest area, averaged over classes; with two classes the usual area."""
    names = F.array(*[F.lit(c) for c in labels])
    long = calls.select(F.col("cancer_type").alias("actual"), F.explode(
        F.arrays_zip(names.alias("class"), F.col("scores").alias("score"))).alias("s")).select(
        "actual", "s.class", "s.score")
    return float(evaluate.roc_auc(long).agg(F.avg("auc").alias("a")).first()["a"] or 0.0)


SCORERS = {"accuracy": lambda calls, labels: accuracy(calls), "roc_auc": mean_auc}


def _fold_probes(long: DataFrame, k: int, prior: str, number: int) -> DataFrame:
    """(node_id, train_of, probe_id): probes chosen without each fold; -1 is without none.

    Moments are taken once per (node, class, probe, fold) and then added up into
    the k+1 training sets, so the matrix is read once.
    """
    parts = dm.class_moments(long, ("fold",))
    sets = F.filter(F.sequence(F.lit(-1), F.lit(k - 1)), lambda f: f != F.col("fold"))
    merged = dm.merge_moments(
        parts.select("*", F.explode(sets).alias("train_of")),
        ["node_id", "cancer_type", "probe_id", "train_of"])
    return dm.top_probes(dm.probe_tests(merged, prior, ("train_of",)), number, ("train_of",)).select(
        "node_id", "train_of", "probe_id").distinct()


def _vectors(rows: DataFrame, node_id: str, labels: list[str], features: list[str], without: int) -> DataFrame:
    """Rows with a value map as (node_id, sample_id, cancer_type, label, classes, fold, train_of, x)."""
    names = F.array(*[F.lit(c) for c in labels])
    return rows.withColumn("x", vector_of("v", features)).filter(F.col("x").isNotNull()).select(
        F.lit(node_id).alias("node_id"), "sample_id", "cancer_type",
        (F.array_position(names, F.col("cancer_type")) - 1).cast("int").alias("label"),
        F.lit(len(labels)).alias("classes"), "fold", F.lit(without).alias("train_of"),
        vector_to_array("x").alias("x"))


def mean_areas(calls: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """(keys, score): the one-vs-rest areas of ``votes``, averaged over the classes, for every
    value of the keys; with two classes the usual area.  Equal votes count half."""
    names = F.array(*[F.lit(c) for c in labels])
    of = [*keys, "class"]
    counted = calls.select(*keys, "cancer_type", F.explode(F.arrays_zip(names.alias("class"), F.col("votes").alias("v")))
                           .alias("s")).select(*keys, "s.class", "s.v", (F.col("s.class") == F.col("cancer_type")).alias("own")) \
        .groupBy(*of, "v").agg(F.count_if("own").alias("yes"), F.count_if(~F.col("own")).alias("no"))
    below = F.coalesce(F.sum("no").over(Window.partitionBy(*of).orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    areas = counted.withColumn("pairs", F.col("yes") * (below + F.col("no") / 2)).groupBy(*of).agg(
        F.try_divide(F.sum("pairs"), F.sum("yes") * F.sum("no")).alias("area"))
    return areas.groupBy(*keys).agg(F.avg("area").alias("score"))


def forest_scores(rows: DataFrame, labels: list[str], points: list[dict], scoring: str, k: int, seed: int) -> list[float]:
    """Mean score over the folds of every point of a forest grid, from the forests that the points share."""
    calls = cut(forest.votes(rows, forest.take_apart(points), k, seed))
    keys = ["point", "fold"]
    if scoring == "accuracy":
        names = F.array(*[F.lit(c) for c in labels])
        called = F.get(names, (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))
        each = calls.groupBy(*keys).agg(F.avg((called == F.col("cancer_type")).cast("double")).alias("score"))
    else:
        each = mean_areas(calls, labels, keys)
    found = dict(each.groupBy("point").agg(F.sum("score") / k).collect())
    return [found.get(n) or 0.0 for n in range(len(points))]


@dataclass
class Search:
    """Outcome of a grid search on one node."""

    model: NodeModel
    best: dict
    scores: list[dict]
    held_out: DataFrame
    train_accuracy: float
    test_accuracy: float
    n_train: int
    n_test: int
    rested: bool = True  # whether the model's fit came to an end by itself


@dataclass
class SearchPlan:
    """What the searches on all nodes start from.

    ``samples``: (node_id, sample_id, cancer_type, held_out, fold), the fold null
    where held out.  ``probes``: (node_id, train_of, probe_id), the probes chosen
    without each fold, -1 for without none.  ``matrix``: (node_id, sample_id,
    probe_id, m_value), each node's own part of the measurements.
    """

    samples: DataFrame
    probes: DataFrame
    matrix: DataFrame


def plan_search(m: DataFrame, design: DataFrame, k: int = ds.FOLDS, prior: str = "robust",
                number: int = dm.TOP_PROBES, seed: int = ds.SEED) -> SearchPlan:
    """Split, folds, chosen probes and reduced matrix of every node of ``design``.

    Only probes with a value in every sample take part, so that no sample is lost
    where probes become vectors.  However many nodes there are, the measurements
    are read to find those probes, to choose among them, and to keep what was
    chosen, in one folder per node.
    """
    m = qc.keep_probes(m, cut(qc.complete_probes(m)))
    unit = ds.shuffle_unit(seed=seed)
    split = ds.split_random(design.select("node_id", "sample_id", "cancer_type"),
                            unit=unit, keys=("node_id",))
    folds = ds.assign_folds(split.filter(~F.col("held_out")), "cancer_type", k,
                            ds.shuffle_unit(seed=seed + 1), ("node_id",))
    samples = cut(folds.unionByName(split.filter("held_out"), allowMissingColumns=True))
    train = samples.filter(~F.col("held_out")).select(
        "node_id", "sample_id", "cancer_type", "fold")
    long = m.select("sample_id", "probe_id", "m_value").join(train, "sample_id")
    probes = cut(_fold_probes(long, k, prior, number))
    matrix = m.select("sample_id", "probe_id", "m_value").join(
        samples.select("node_id", "sample_id"), "sample_id").join(
        probes.select("node_id", "probe_id").distinct(), ["node_id", "probe_id"], "left_semi")
    return SearchPlan(samples, probes, cut(matrix, partition_by="node_id"))


def search(plan: SearchPlan, node_id: str, model_type: str = "svm", grid: dict | None = None, scoring: str = "accuracy",
           k: int = ds.FOLDS, seed: int = ds.SEED, name: str | None = None,
           workers: int = WORKERS) -> Search:
    """Cross-validated grid search on one node; the best point is refitted."""
    grid = model_grid(model_type) if grid is None else grid
    if model_type not in MODEL_GRIDS:
        model_grid(model_type)
    chosen: dict[int, list[str]] = {}
    for row in plan.probes.filter(F.col("node_id") == node_id).orderBy("probe_id").collect():
        chosen.setdefault(row["train_of"], []).append(row["probe_id"])
    wanted = sorted({p for some in chosen.values() for p in some})
    mine = plan.samples.filter(F.col("node_id") == node_id).select(
        "sample_id", "cancer_type", "held_out", "fold")
    own = plan.matrix.filter(F.col("node_id") == node_id)
    rows = cut(mine.join(value_maps(own, wanted), "sample_id"))
    labels = sorted(r[0] for r in mine.select("cancer_type").distinct().collect())
    train = rows.filter(~F.col("held_out"))
    test = rows.filter("held_out")
    n_train, n_test = train.count(), test.count()
    score_of = SCORERS[scoring]

    points = grid_points(grid)
    most = max(len(some) for some in chosen.values())
    mapped = svm.KERNEL_BYTES is not None and n_train * n_train * 8 > svm.KERNEL_BYTES
    if model_type == "svm" and scoring == "accuracy" and (
            not mapped or n_train * max(most, svm.LANDMARKS) * 8 <= svm.MAPPED_BYTES):
        folds = reduce(DataFrame.unionByName, [
            _vectors(train, node_id, labels, chosen[fold], fold) for fold in range(k)])
        right = F.avg((F.col("label") == F.col("called")).cast("double"))
        found = dict(svm.calls(folds, points, k, mapped).groupBy("point", "fold").agg(right.alias("score"))
                     .groupBy("point").agg(F.sum("score") / k).collect())
        totals = [found.get(n) or 0.0 for n in range(len(points))]
        best_at = max(range(len(points)), key=lambda i: totals[i])
        machine = svm.machine(_vectors(train, node_id, labels, chosen[-1], -1), points[best_at],
                              scratch_path(train.sparkSession, "machine"), mapped)
        return _found(node_id, name, chosen[-1], labels, machine, machine.rested, points, totals, best_at,
                      train, test, n_train, n_test)
    if model_type == "random_forest" and n_train * most * 8 <= forest.GROUP_BYTES:
        folds = reduce(DataFrame.unionByName, [
            _vectors(train, node_id, labels, chosen[fold], fold) for fold in range(k)])
        totals = forest_scores(folds, labels, points, scoring, k, seed)
        best_at = max(range(len(points)), key=lambda i: totals[i])
        fitted = forest.model(_vectors(train, node_id, labels, chosen[-1], -1),
                              _labelled(train, labels, chosen[-1], n_train), points[best_at], seed,
                              scratch_path(train.sparkSession, "forest"))
        return _found(node_id, name, chosen[-1], labels, fitted, True, points, totals, best_at,
                      train, test, n_train, n_test)
    weighted = any(p.get("class_weight") == "balanced" for p in points)
    totals = [0.0] * len(points)
    for fold in range(k):
        fit_on = _labelled(train.filter(F.col("fold") != fold), labels, chosen[fold], n_train,
                           weighted).persist()
        n_fit = fit_on.count()
        check = train.filter(F.col("fold") == fold).persist()

        def trial(point: dict) -> float:
            stages, _ = _fit(fit_on, model_type, point, len(labels), n_fit, seed)
            model = NodeModel(node_id, chosen[fold], labels, stages)
            return score_of(model.transform(check), labels)

        # Every trial is Spark jobs; the pool only keeps several of them going.
        with ThreadPool(min(workers, len(points))) as pool:
            scored = pool.map(inheritable_thread_target(plan.samples.sparkSession)(trial), points)
        totals = [t + s / k for t, s in zip(totals, scored)]
        fit_on.unpersist()
        check.unpersist()
    best_at = max(range(len(points)), key=lambda i: totals[i])
    whole = _labelled(train, labels, chosen[-1], n_train, weighted).persist()
    stages, rested = _fit(whole, model_type, points[best_at], len(labels), n_train, seed)
    whole.unpersist()
    return _found(node_id, name, chosen[-1], labels, stages, rested, points, totals, best_at, train, test, n_train, n_test)


def _found(node_id, name, features, labels, stages, rested, points, totals, best_at, train, test, n_train, n_test) -> Search:
    best = NodeModel(name or node_id, features, labels, stages, points[best_at])
    return Search(
        best, points[best_at], [{**p, "score": s} for p, s in zip(points, totals)],
        test.select("sample_id", "cancer_type"), accuracy(best.transform(train)),
        accuracy(best.transform(test)), n_train, n_test, rested)


# -- outcomes kept --------------------------------------------------------------

OUTCOME = """node_id string, best string, scores string, train_accuracy double, test_accuracy double,
    n_train long, n_test long, rested boolean"""


def outcome_path(store: str, node_id: str, model_type: str, *settings) -> str:
    """Where a search's outcome is kept; other settings are other outcomes."""
    asked = json.dumps([node_id, model_type, *settings], sort_keys=True, default=str)
    return f"{store}/{model_type}-{hashlib.sha256(asked.encode()).hexdigest()[:16]}"


def save_outcome(found: Search, spark: SparkSession, node_id: str, path: str) -> None:
    """Keep a search; its row is written last, so that an outcome is whole or not there."""
    found.model.save(spark, f"{path}/fitted")
    found.held_out.write.mode("overwrite").parquet(f"{path}/held_out")
    spark.createDataFrame([(node_id, json.dumps(found.best), json.dumps(found.scores), found.train_accuracy,
                            found.test_accuracy, found.n_train, found.n_test, found.rested)], OUTCOME) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/outcome")


def load_outcome(spark: SparkSession, path: str) -> Search | None:
    """A search that was kept; none if it never came to its end."""
    if not written(spark, f"{path}/outcome"):
        return None
    row = spark.read.parquet(f"{path}/outcome").first()
    return Search(load_model(spark, f"{path}/fitted"), json.loads(row.best), json.loads(row.scores),
                  spark.read.parquet(f"{path}/held_out"), row.train_accuracy, row.test_accuracy,
                  row.n_train, row.n_test, row.rested)


def search_nodes(plan: SearchPlan, model_type: str = "svm", grid: dict | None = None, scoring: str = "accuracy",
                 k: int = ds.FOLDS, seed: int = ds.SEED, store: str | None = None,
                 names: dict[str, str] | None = None) -> dict[str, Search | Exception]:
    """The search of every node of the plan, or the error that ended it.

    With ``store``, a folder for one data set and plan, outcomes are kept as
    they come and those that are there already are read, so that a run that was
    ended goes on, and whoever asks for the same search later fits nothing.
    """
    spark = plan.samples.sparkSession
    grid = model_grid(model_type) if grid is None else grid
    nodes = sorted(r[0] for r in plan.samples.select("node_id").distinct().collect())

    def one(node_id: str) -> Search | Exception:
        try:
            path = store and outcome_path(store, node_id, model_type, grid, scoring, k, seed)
            found = load_outcome(spark, path) if path else None
            if found is None:
                found = search(plan, node_id, model_type, grid, scoring, k, seed)
                if path:
                    save_outcome(found, spark, node_id, path)
            found.model.name = (names or {}).get(node_id, node_id)
            return found
        except Exception as error:  # noqa: BLE001  one node's error does not stop the others
            return error

    with ThreadPool(NODE_WORKERS) as pool:
        done = pool.map(inheritable_thread_target(spark)(one), nodes, chunksize=1)
    return dict(zip(nodes, done))


STATS = """node_id string, name string, status string, n_train long, n_test long,
    n_features long, best string, train_accuracy double, test_accuracy double, error string"""


def train_tree(m: DataFrame, nodes: DataFrame, samples: DataFrame, model_type: str = "svm",
               grid: dict | None = None, path: str | None = None, prior: str = "robust",
               number: int = dm.TOP_PROBES, seed: int = ds.SEED,
               design: DataFrame | None = None, plan: SearchPlan | None = None,
               store: str | None = None) -> tuple[dict[str, NodeModel], DataFrame]:
    """A model for every node whose data set is large enough, and a table about all nodes.

    A node that cannot be trained is "skipped"; one that fails keeps its error
    and does not stop the others.  ``store`` as for :func:`search_nodes`.
    """
    model_grid(model_type)
    spark = m.sparkSession
    if design is None:
        design = ds.node_design(m, nodes, samples)
    if plan is None:
        plan = plan_search(m, design, prior=prior, number=number, seed=seed)
    # The hierarchy is small: one row per node, in depth-first order.
    order = nodes.select("node_id", "name", "preorder").orderBy("preorder").collect()
    names = {n["node_id"]: n["name"] for n in order}
    searches = search_nodes(plan, model_type, grid, seed=seed, store=store, names=names)
    models, rows = {}, []
    for node_id, name in names.items():
        found = searches.get(node_id)
        if found is None:
            rows.append((node_id, name, "skipped") + (None,) * 7)
        elif isinstance(found, Exception):
            rows.append((node_id, name, "failed") + (None,) * 6 + (str(found),))
        else:
            if path:
                found.model.save(spark, f"{path}/{name}")
            models[name] = found.model
            rows.append((node_id, name, "trained", found.n_train, found.n_test, len(found.model.features),
                         json.dumps(found.best), found.train_accuracy, found.test_accuracy,
                         None if found.rested else "not converged"))
    return models, spark.createDataFrame(rows, STATS)


def training_summary(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("status") != "skipped").select(
        "name", "status", "n_train", "n_features", "train_accuracy", "test_accuracy", "error")


def training_size(m: DataFrame, design: DataFrame) -> DataFrame:
    """(node_id, n_samples, n_probes) that the search on each node of ``design`` uses."""
    whole = qc.complete_probes(m).agg(F.count(F.lit(1)).alias("n"))
    return design.groupBy("node_id").agg(F.countDistinct("sample_id").alias("n_samples")).withColumn(
        "n_probes", whole.scalar())


def complete_features(m: DataFrame, samples: DataFrame, features: list[str]) -> list[str]:
    """Those of the listed features that have a value in every listed sample, in their order."""
    ids = samples.select("sample_id").distinct()
    cells = m.join(ids, "sample_id", "left_semi").filter(F.col("probe_id").isin(features))
    known = cells.groupBy("probe_id").agg(
        F.countDistinct(F.when(F.col("m_value").isNotNull(), F.col("sample_id"))).alias("n"))
    whole = {r[0] for r in known.filter(F.col("n") == ids.count()).collect()}
    return [f for f in features if f in whole]


def refit(m: DataFrame, nodes: DataFrame, samples: DataFrame, records: DataFrame,
          seed: int = ds.SEED) -> tuple[dict[str, NodeModel], DataFrame]:
    """Refit the model of every parameter record on all labelled samples.

    ``records`` is one row per model: (model_name, model_type, parameters,
    feature_names).  Labels are the children of the node of that name.  Features
    that some labelled sample has no value of are left out, so that every sample
    with data is fitted on; ``n_samples`` counts the rows that were.
    """
    spark = m.sparkSession
    # All records' features are taken out of the measurements in one pass.
    listed = records.select(F.explode("feature_names").alias("probe_id")).distinct()
    m = cut(m.select("sample_id", "probe_id", "m_value").join(listed, "probe_id", "left_semi"))
    by_name = tree.find_by_name(nodes)
    below = tree.samples_below(nodes, samples)

    def fit(record) -> tuple[NodeModel | None, tuple]:
        name = record["model_name"]
        try:
            model_type = RECORD_TYPES.get(record["model_type"])
            if model_type is None:
                raise ValueError(f"Unsupported model type: {record['model_type']}")
            params = {k: _typed(v) for k, v in (record["parameters"] or {}).items()}
            node = by_name.filter(F.col("name") == name).select(F.col("node_id").alias("parent_id"))
            child = nodes.join(node, "parent_id", "left_semi").select(
                "node_id", F.col("name").alias("cancer_type"))
            design = child.join(below, "node_id").select("sample_id", "cancer_type").join(
                m.select("sample_id").distinct(), "sample_id", "left_semi")
            features = complete_features(m, design, record["feature_names"])
            if not features:
                raise ValueError("no feature has a value in every sample")
            rows = design.join(value_maps(m, features), "sample_id").persist()
            sizes = rows.groupBy("cancer_type").count().collect()
            labels, n = sorted(r["cancer_type"] for r in sizes), sum(r["count"] for r in sizes)
            train = _labelled(rows, labels, features, n,
                              params.get("class_weight") == "balanced").persist()
            fitted = train.count()
            if model_type == "random_forest" and n * len(features) * 8 > SPARK_ML_BYTES:
                vectors = _vectors(rows.withColumn("fold", F.lit(None).cast("int")), name, labels, features, -1)
                stages, rested = forest.model(vectors, train, params, seed, scratch_path(spark, "forest"), TOGETHER), True
            else:
                stages, rested = _fit(train, model_type, params, len(labels), n, seed)
            train.unpersist()
            rows.unpersist()
            return (NodeModel(name, features, labels, stages, params),
                    (name, "fitted", fitted, len(features),
                     None if rested else "not converged"))
        except Exception as error:  # noqa: BLE001
            return None, (name, "failed", None, None, str(error))

    with ThreadPool(NODE_WORKERS) as pool:
        done = pool.map(inheritable_thread_target(spark)(fit), records.collect(), chunksize=1)
    models = {model.name: model for model, _ in done if model is not None}
    return models, spark.createDataFrame(
        [row for _, row in done],
        "model string, status string, n_samples long, n_features long, error string")


def _typed(text):
    """A parameter written as text; "None" and empty text are no value."""
    if text is None or text in ("", "None", "null"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def importances(spark: SparkSession, models: dict[str, NodeModel],
                positive_only: bool = True) -> DataFrame:
    """(model, probe_id, importance) of forest models; a few hundred rows per model."""
    rows = []
    for name, model in models.items():
        last = model.stages.stages[-1]
        if hasattr(last, "featureImportances"):
            weights = last.featureImportances.toArray()
            rows += [(name, p, float(w)) for p, w in zip(model.features, weights)]
    out = spark.createDataFrame(rows, "model string, probe_id string, importance double")
    return out.filter("importance > 0") if positive_only else out


def calibrate(scored: DataFrame, labels: list[str], method: str = "sigmoid") -> DataFrame:
    """Calibrated probabilities of a fitted model, one-vs-rest, summing to one.

    ``scored`` holds (sample_id, cancer_type, scores).  With two classes only the
    second is calibrated and the first is its complement.
    """
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"Unsupported calibration: {method}")
    binary = len(labels) == 2
    out = cut(scored)  # each class's fit reads the scores, none computes them again
    for i, label in enumerate(labels):
        if binary and i == 0:
            continue
        score = F.get("scores", F.lit(i))
        target = (F.col("cancer_type") == label).cast("double")
        data = out.withColumn("_y", target)
        if method == "sigmoid":
            data = data.withColumn("_x", array_to_vector(F.array(score)))
            fit = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p",
                                     probabilityCol="_pr", rawPredictionCol="_raw").fit(data)
            out = fit.transform(data).withColumn(
                f"_c{i}", F.get(vector_to_array("_pr"), F.lit(1))).drop("_p", "_pr", "_raw")
        else:
            data = data.withColumn("_x", score)
            fit = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_p").fit(data)
            out = fit.transform(data).withColumnRenamed("_p", f"_c{i}")
        out = out.drop("_x", "_y")
    if binary:
        out = out.withColumn("_c0", 1 - F.col("_c1"))
    parts = [F.col(f"_c{i}") for i in range(len(labels))]
    total = sum(parts[1:], parts[0])
    even = F.lit(1.0 / len(labels))
    shares = F.array(*[F.when(total > 0, p / total).otherwise(even) for p in parts])
    return out.withColumn("calibrated", shares).drop(*[f"_c{i}" for i in range(len(labels))])


# -- cohort embedding ---------------------------------------------------------

@dataclass
class Embedding:
    """A fitted three-dimensional projection of a node's important probes."""

    name: str
    features: list[str]
    model: PCAModel

    def project(self, maps: DataFrame) -> DataFrame:
        """(sample_id, x, y, z) of rows with a complete probe -> value map."""
        ready = maps.withColumn("features", vector_of("v", self.features)).filter(
            F.col("features").isNotNull())
        at = vector_to_array("_at")
        return self.model.transform(ready).select(
            "sample_id", *[F.get(at, F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def fit_embedding(m: DataFrame, design: DataFrame, weights: DataFrame, name: str) -> Embedding:
    """Project the samples of ``design`` on the probes with positive importance.

    Probes that one of the samples has no value of are left out.
    """
    features = sorted(r[0] for r in weights.filter(
        (F.col("model") == name) & (F.col("importance") > 0)).select("probe_id").collect())
    held = design.join(m.select("sample_id").distinct(), "sample_id", "left_semi")
    features = complete_features(m, held, features)
    if len(features) < 3:
        raise ValueError(f"Too few features with importance > 0 for {name}")
    maps = value_maps(m.join(design.select("sample_id").distinct(), "sample_id", "left_semi"),
                      features)
    ready = maps.withColumn("features", vector_of("v", features)).filter(
        F.col("features").isNotNull())
    return Embedding(name, features,
                     PCA(k=3, inputCol="features", outputCol="_at").fit(ready))


def embed(embedding: Embedding, m: DataFrame) -> DataFrame:
    """(sample_id, x, y, z) of the samples with all of the embedding's probes."""
    return embedding.project(value_maps(m, embedding.features))


def project_missing(embedding: Embedding, placed: DataFrame, m: DataFrame,
                    wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add wanted samples that are not placed yet; gaps are filled from neighbours.

    Returns (placed and projected samples, wanted samples without any data).
    """
    todo = wanted.select("sample_id").distinct().join(
        placed.select("sample_id"), "sample_id", "left_anti")
    cells = m.filter(F.col("probe_id").isin(embedding.features))
    have = cells.select("sample_id").distinct()
    known = todo.join(have, "sample_id", "left_semi")
    filled = impute.impute_knn(cells, embedding.features, targets=known)
    new = embed(embedding, filled.join(known, "sample_id", "left_semi"))
    out = placed.select("sample_id", "x", "y", "z").unionByName(new)
    return out, todo.join(have, "sample_id", "left_anti")


def plot_table(placed: DataFrame, labels: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Placed samples with their label; ``new`` rows bring a predicted label along."""
    out = placed.join(labels, "sample_id")
    return out if new is None else out.unionByName(new.select(*out.columns))


def class_centroids(plot: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Centre and height of each class, optionally for a listed cohort only."""
    rows = plot if cohort is None else plot.join(cohort, "sample_id", "left_semi")
    return rows.groupBy("cancer_type").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"),
        (F.max("y") - F.min("y")).alias("y_range"))
