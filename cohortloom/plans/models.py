"""Registered queries: training, prediction and embeddings."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from threading import Lock
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators import dataset as ds, evaluate as ev, inference as inf, qc, training as tr, tree
from . import standins as st
from ..session import application_root
from .registry import Query
from .samples import class_tree


_plans: dict[tuple[str, str], tuple] = {}
_lock = Lock()


def _planned(spark, d):
    """The matrix, the hierarchy, and the plan of the searches, made once per application and data."""
    key = (spark.sparkContext.applicationId, d)
    with _lock:
        if key not in _plans:
            m, (nodes, held) = st.vector_matrix(spark, d), class_tree(spark, d)
            _plans[key] = m, nodes, held, tr.plan_search(m, ds.node_design(m, nodes, held))
        return _plans[key]


def _store(spark, d):
    """The folder of this application's search outcomes on that data."""
    return f"{application_root(spark)}/searches/{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def _searches(spark, d, model_type):
    """The matrix, the plan and the search of every trainable node, on the operators' own defaults."""
    m, _, _, plan = _planned(spark, d)
    found = tr.search_nodes(plan, model_type, store=_store(spark, d))
    for search in found.values():
        if isinstance(search, Exception):
            raise search
    return m, plan, found


def _scores(spark, searches):
    rows = [(node, json.dumps({k: v for k, v in s.items() if k != "score"}), float(s["score"]),
             found.n_train, found.n_test, found.test_accuracy)
            for node, found in searches.items() for s in found.scores]
    return spark.createDataFrame(
        rows, "node_id string, params string, score double, n_train long, n_test long, test_accuracy double")


def svm_cv(spark, d):
    return _scores(spark, _searches(spark, d, "svm")[2])


def forest_cv(spark, d):
    return _scores(spark, _searches(spark, d, "random_forest")[2])


def forest_auc_search(spark, d):
    m = st.vector_matrix(spark, d)
    design = st.table(spark, d, "embeddings").select(
        F.lit("B").alias("node_id"), F.col("vec_id").alias("sample_id"),
        F.when(F.col("label") < 5, "low").otherwise("high").alias("cancer_type"))
    found = tr.search(tr.plan_search(m, design), "B", "random_forest", tr.AUC_FOREST_GRID, "roc_auc")
    return _scores(spark, {"B": found})


def _whole_models(spark, d, m=None):
    """One forest per inner node from a parameter table, fitted on all samples (or those of a matrix)."""
    nodes, held = class_tree(spark, d)
    m = st.vector_matrix(spark, d) if m is None else m
    probes = [f"d{i}" for i in range(64)] + ["not_on_the_array"]
    inner = [st.CLASS_ROOT] + sorted(
        r[0] for r in tree.at_level(nodes, 2).select("name").collect())
    records = spark.createDataFrame(
        [(n, "RandomForestClassifier",
          {"n_estimators": "100", "max_features": "sqrt"}, probes)
         for n in inner],
        "model_name string, model_type string, parameters map<string,string>, "
        "feature_names array<string>")
    models, status = tr.refit(m, nodes, held, records)
    return m, nodes, held, models, status


def refit_models(spark, d):
    return _whole_models(spark, d)[4]


def importances(spark, d):
    return tr.importances(spark, _whole_models(spark, d)[3])


def _trained(spark, d):
    m, nodes, held, plan = _planned(spark, d)
    return tr.train_tree(m, nodes, held, "random_forest", plan=plan, store=_store(spark, d))


def node_training_stats(spark, d):
    return _trained(spark, d)[1]


def training_summary(spark, d):
    return tr.training_summary(_trained(spark, d)[1])


def calibrated(spark, d):
    m, plan, searches = _searches(spark, d, "random_forest")

    def of(node, found):
        labels = plan.samples.filter(F.col("node_id") == node).select("sample_id", "cancer_type")
        scored = inf.validation_calls(m, found.model, labels).withColumnRenamed("actual", "cancer_type")
        names = found.model.labels
        return tr.calibrate(scored, names).select(
            F.lit(node).alias("node_id"), "sample_id", "cancer_type", F.explode(F.arrays_zip(
                F.array(*[F.lit(c) for c in names]).alias("class"),
                F.col("calibrated").alias("p"))).alias("c")).select(
            "node_id", "sample_id", "cancer_type", "c.class", F.round("c.p", 6).alias("probability"))

    return reduce(DataFrame.unionByName, [of(*x) for x in searches.items()])


def predict_tree(spark, d):
    m, _, _, models, _ = _whole_models(spark, d)
    return inf.predict_tree(m, models, st.CLASS_ROOT)


def predict_final(spark, d):
    m, _, _, models, _ = _whole_models(spark, d)
    asked = st.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    found = inf.predict_tree(m, models, st.CLASS_ROOT, asked)
    return inf.final_predictions(found, asked, models, st.CLASS_ROOT)


def _embedding(spark, d, m=None):
    m, nodes, held, models, _ = _whole_models(spark, d, m)
    weights = tr.importances(spark, models)
    fitted = tr.fit_embedding(m, held, weights, st.CLASS_ROOT)
    return m, nodes, held, models, fitted


def cohort_embedding(spark, d):
    m, _, _, _, fitted = _embedding(spark, d)
    return tr.embed(fitted, m)


def project_missing(spark, d):
    """Place the complete samples, then project those with gaps.

    The complete samples are what the models and the embedding are fitted on, so that no probe is
    left out for a sample that lacks it: such samples have their gaps filled.
    """
    gappy = st.vector_matrix(spark, d)
    _, _, held, _, fitted = _embedding(spark, d, qc.drop_sparse_samples(gappy, 0))
    whole, _ = tr.project_missing(fitted, tr.embed(fitted, gappy), gappy, held)
    return whole


def train_gaps(spark, d):
    """What the search on each node uses of a matrix with gaps, as its plan has it."""
    plan = _planned(spark, d)[3]
    probes = plan.probes.filter("train_of = -1").groupBy("node_id").agg(
        F.countDistinct("probe_id").alias("n_probes"))
    return plan.samples.groupBy("node_id").agg(F.countDistinct("sample_id").alias("n_samples")).join(
        probes, "node_id")


class Threshold(NamedTuple):
    """A model without training: the class whose turn it is by the probes' sum."""

    features: list[str]
    labels: list[str]

    def transform(self, rows, values="v"):
        cells = [F.try_element_at(F.col(values), F.lit(p)) for p in self.features]
        total = cells[0]
        for cell in cells[1:]:
            total = total + cell
        names = F.array(*[F.lit(c) for c in self.labels])
        return rows.withColumn("_sum", total).filter(F.col("_sum").isNotNull()).select(
            *rows.columns, F.when(F.col("_sum") > 0, names[0]).otherwise(names[1]).alias("prediction"),
            F.lit(1.0).alias("probability"), F.lit(None).cast("array<double>").alias("scores"))


#: A root and one model below it, on probes some samples lack.
FIXED_MODELS = {"top": Threshold(["d0", "d3"], ["low", "leaf"]), "low": Threshold(["d6", "d9"], ["x", "y"])}


def fixed_predictions(spark, d):
    return inf.predict_tree(st.vector_matrix(spark, d), FIXED_MODELS, "top")


def not_scored(spark, d):
    m = st.vector_matrix(spark, d)
    lost = inf.not_scored(m, fixed_predictions(spark, d), FIXED_MODELS, "top")
    return lost.withColumn("missing", F.array_join("missing", ","))


def fixed_final(spark, d):
    """The deepest call of every document's number, whether or not a sample has it."""
    asked = st.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    return inf.final_predictions(fixed_predictions(spark, d), asked, FIXED_MODELS, "top")


def _places(spark, d):
    return st.table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), *[
        F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def fixed_report(spark, d):
    """Calls with the sample's place, which only the root's embedding has, and its recorded class."""
    located = st.class_samples(spark, d).withColumnRenamed("disease_name", "name")
    return inf.sample_report(fixed_predictions(spark, d),
                             _places(spark, d).withColumn("model", F.lit("top")), located)


def requested_samples(spark, d):
    """Which of the asked numbers have measurements."""
    asked = st.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    known, unknown = inf.requested(st.vector_matrix(spark, d), asked)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


def requested_patients(spark, d):
    """The same for all samples (orders) of the patients (customers) of one segment."""
    sample = st.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("patient_id"))
    patients = st.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("patient_id"))
    known, unknown = inf.requested_patients(st.vector_matrix(spark, d), sample, patients)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


def binary_calls(spark, d):
    scored = _places(spark, d).select("sample_id", ((F.col("x") + 1) / 2).alias("probability"))
    return inf.binary_call(scored)


def plot_with_new(spark, d):
    """Recorded samples with their class, and the others, placed with what was called for them."""
    places = _places(spark, d)
    cohort = st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    labels = st.class_samples(spark, d).select("sample_id", F.col("disease_name").alias("cancer_type"))
    new = places.join(cohort, "sample_id", "left_anti")
    called = inf.final_predictions(fixed_predictions(spark, d), new, FIXED_MODELS, "top")
    return tr.plot_table(places.join(cohort, "sample_id", "left_semi"), labels, new.join(
        called.withColumnRenamed("prediction", "cancer_type"), "sample_id"))


def class_centroids(spark, d):
    plot = st.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
        F.get("embedding", F.lit(2)).cast("double").alias("z"))
    labels = st.class_samples(spark, d).select(
        "sample_id", F.col("disease_name").alias("cancer_type"))
    cohort = st.table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    out = tr.class_centroids(tr.plot_table(plot, labels), cohort)
    return out.withColumns({c: F.round(c, 6) for c in ("x", "y", "y_range")})


def sample_report(spark, d):
    m, nodes, held, models, fitted = _embedding(spark, d)
    placed = tr.embed(fitted, m).withColumn("model", F.lit(st.CLASS_ROOT))
    return inf.sample_report(inf.predict_tree(m, models, st.CLASS_ROOT), placed,
                             tree.locate(nodes, held))


def validation_report(spark, d):
    """Per-class report of every node's model on its held-out samples."""
    m, _, searches = _searches(spark, d, "random_forest")
    return reduce(DataFrame.unionByName, [
        ev.class_report(inf.validation_calls(m, found.model, found.held_out)).withColumn("node_id", F.lit(node))
        for node, found in searches.items()])


_FIXED = f"""WITH m AS ({st.VECTOR_MATRIX}),
  w AS (SELECT sample_id,
          max(m_value) FILTER (probe_id = 'd0') + max(m_value) FILTER (probe_id = 'd3') AS top,
          max(m_value) FILTER (probe_id = 'd6') + max(m_value) FILTER (probe_id = 'd9') AS low
        FROM m GROUP BY 1),
  pred AS (
    SELECT sample_id, CAST(1 AS INTEGER) AS depth, 'top' AS model,
      CASE WHEN top > 0 THEN 'low' ELSE 'leaf' END AS prediction, CAST(1 AS DOUBLE) AS probability
    FROM w WHERE top IS NOT NULL
    UNION ALL
    SELECT sample_id, CAST(2 AS INTEGER), 'low', CASE WHEN low > 0 THEN 'x' ELSE 'y' END,
      CAST(1 AS DOUBLE) FROM w WHERE top > 0 AND low IS NOT NULL)"""

_PLACES = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz", 1))
_FINAL = f"""{_FIXED},
  final AS (SELECT sample_id, arg_max(prediction, depth) AS prediction FROM pred GROUP BY 1)"""

QUERIES = {
    "svm_cv": Query(svm_cv),
    "forest_cv": Query(forest_cv),
    "forest_auc_search": Query(forest_auc_search),
    "calibrated_scores": Query(calibrated),
    "node_training_stats": Query(node_training_stats),
    "training_summary": Query(training_summary),
    "refit_models": Query(refit_models),
    "importances": Query(importances),
    "predict_tree": Query(predict_tree),
    "predict_final": Query(predict_final),
    "sample_report": Query(sample_report),
    "validation_report": Query(validation_report),
    "cohort_embedding": Query(cohort_embedding),
    "project_missing": Query(project_missing),
    "train_gaps": Query(
        train_gaps,
        f"""WITH m AS ({st.VECTOR_MATRIX}), design AS ({st.CLASS_DESIGN})
            SELECT node_id, count(DISTINCT sample_id) AS n_samples,
              (SELECT count(*) FROM (SELECT probe_id FROM m GROUP BY 1
                 HAVING count(DISTINCT sample_id) FILTER (m_value IS NOT NULL)
                   = (SELECT count(DISTINCT sample_id) FROM m))) AS n_probes
            FROM design GROUP BY 1"""),
    "fixed_predictions": Query(fixed_predictions, f"{_FIXED} SELECT * FROM pred"),
    "fixed_final": Query(
        fixed_final,
        f"""{_FINAL} SELECT doc_id AS sample_id, prediction
            FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN final ON sample_id = doc_id"""),
    "fixed_report": Query(
        fixed_report,
        f"""{_FIXED},
              e AS (SELECT vec_id, 'C' || CAST(label AS VARCHAR) AS recorded_diagnosis, {_PLACES}
                    FROM embeddings)
            SELECT pred.*, CASE WHEN model = 'top' THEN x END AS x, CASE WHEN model = 'top' THEN y END AS y,
              CASE WHEN model = 'top' THEN z END AS z, recorded_diagnosis
            FROM pred LEFT JOIN e ON vec_id = sample_id"""),
    "requested_samples": Query(
        requested_samples,
        """SELECT DISTINCT doc_id AS sample_id, doc_id IN (SELECT vec_id FROM embeddings) AS known
           FROM documents"""),
    "requested_patients": Query(
        requested_patients,
        """SELECT DISTINCT o_orderkey AS sample_id, o_orderkey IN (SELECT vec_id FROM embeddings) AS known
           FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""),
    "binary_calls": Query(
        binary_calls,
        """SELECT sample_id, probability, CAST(probability >= 0.5 AS INTEGER) AS call
           FROM (SELECT vec_id AS sample_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS probability
                 FROM embeddings)"""),
    "plot_with_new": Query(
        plot_with_new,
        f"""{_FINAL}, e AS (SELECT vec_id AS sample_id, {_PLACES}, label,
                vec_id IN (SELECT s_suppkey FROM supplier) AS old FROM embeddings)
            SELECT e.sample_id, x, y, z, CASE WHEN old THEN 'C' || CAST(label AS VARCHAR)
              ELSE prediction END AS cancer_type
            FROM e LEFT JOIN final ON final.sample_id = e.sample_id"""),
    "not_scored": Query(
        not_scored,
        f"""{_FIXED}
            SELECT sample_id, model, string_agg(probe_id, ',' ORDER BY probe_id) AS missing
            FROM (SELECT sample_id, 'top' AS model, unnest(['d0', 'd3']) AS probe_id FROM w
                  UNION ALL SELECT sample_id, 'low', unnest(['d6', 'd9']) FROM w WHERE top > 0) x
            JOIN m USING (sample_id, probe_id) WHERE m_value IS NULL GROUP BY 1, 2"""),
    "class_centroids": Query(
        class_centroids,
        """SELECT 'C' || CAST(label AS VARCHAR) AS cancer_type,
             round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x,
             round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y,
             round(max(CAST(embedding[2] AS DOUBLE)) - min(CAST(embedding[2] AS DOUBLE)), 6)
               AS y_range
           FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer) GROUP BY 1"""),
}
