"""Registered queries: clinical look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clinical as cl
from . import standins as st
from .registry import Query


def purity_samples(spark, d):
    c = st.clinical(spark, d)
    return cl.purity_of(c["xref"], c["biosample"], c["purity"]).select(
        "biosample_id", "analysis_set_id", "purity_id", "purity")


def pure_tree_samples(spark, d):
    c = st.clinical(spark, d)
    held = c["biosample"].select(F.col("sample_type").alias("disease_name"),
                                 F.col("biosample_id").alias("sample_id"))
    return cl.pure_samples(held, cl.purity_of(c["xref"], c["biosample"], c["purity"]))


def pure_patients(spark, d):
    c = st.clinical(spark, d)
    sample = st.table(spark, d, "customer").select(
        F.col("c_name").alias("sample_id"), F.col("c_custkey").alias("patient_id"))
    return cl.pure_patients_samples(sample, c["analysis_set"], c["purity"], 0.9)


def convert(spark, d):
    c = st.clinical(spark, d)
    return cl.convert_ids(c["xref"], c["biosample"], "wgs", "methylation")


def siblings(spark, d):
    c = st.clinical(spark, d)
    tumours = c["biosample"].filter("biosample_status = 'tumour'").select("biosample_id")
    return cl.methylation_siblings(c["xref"], c["biosample"], tumours)


def projection(spark, d):
    ids = st.table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    return cl.project(st.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"],
                      ids, key="o_custkey")


def diagnosis_list(spark, d):
    return cl.diagnoses(st.table(spark, d, "customer"), "c_mktsegment")


def patient_samples(spark, d):
    o = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"),
                                            F.col("o_custkey").alias("patient_id"))
    rich = st.table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return cl.sample_ids(o, None, None, rich)


def all_methylation_ids(spark, d):
    c = st.clinical(spark, d)
    sample = c["biosample"].select(F.col("biosample_id").alias("sample_id"))
    return cl.sample_ids(sample, c["xref"], c["biosample"])


def _classifier_tables(spark, d):
    o, cu = st.table(spark, d, "orders"), st.table(spark, d, "customer")
    n, r = st.table(spark, d, "nation"), st.table(spark, d, "region")
    sample = cu.select(F.col("c_custkey").alias("sample_id"),
                       F.col("c_custkey").alias("meth_sample_id"))
    curated = o.select(F.col("o_custkey").alias("sample_id"),
                       (F.col("o_orderkey") % 25).alias("meth_group_id"),
                       F.col("o_totalprice").alias("meth_class_score"))
    group = n.select(F.col("n_nationkey").alias("meth_group_id"),
                     F.col("n_regionkey").alias("meth_classifier_id"),
                     F.col("n_name").alias("group_name"))
    classifier = r.select(F.col("r_regionkey").alias("meth_classifier_id"),
                          F.col("r_name").alias("name"))
    return sample, curated, group, classifier


def classifier_join(spark, d):
    return cl.classifier_results(*_classifier_tables(spark, d))


def flattened(spark, d):
    """Later tables overwrite equal names: the nation's key replaces the supplier's."""
    s = st.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), "s_acctbal")
    n = st.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return cl.flatten(s, n, on="nation")


def pivot(spark, d):
    ev = st.table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("name"),
        F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version"),
        "event_id", F.col("props").alias("call"))
    kinds = [f"{k}_v{v}" for k in ("click", "error", "purchase", "signup", "view")
             for v in (1, 2)]
    return cl.classifier_pivot(ev, ["call"], "event_id", kinds)


_C = f"WITH {st.CLINICAL}"
_PURE = """SELECT x.biosample_id, x.analysis_set_id, purity_id, purity
  FROM xref x JOIN biosample b ON b.biosample_id = x.biosample_id
  JOIN purity p ON p.analysis_set_id = x.analysis_set_id
  WHERE sample_type = 'wgs' AND biosample_status = 'tumour' AND biosample_type = 'dna'"""
_PAIRS = """FROM xref a JOIN xref b ON a.analysis_set_id = b.analysis_set_id
  JOIN biosample s ON s.biosample_id = a.biosample_id
  JOIN biosample t ON t.biosample_id = b.biosample_id
  WHERE s.sample_type = 'wgs' AND t.sample_type = 'methylation'"""

QUERIES = {
    "purity_samples": Query(purity_samples, f"{_C} {_PURE}"),
    "pure_tree_samples": Query(
        pure_tree_samples,
        f"""{_C} SELECT sample_type AS disease_name, biosample_id AS sample_id FROM biosample
            WHERE biosample_id IN (SELECT biosample_id FROM ({_PURE}) WHERE purity > 0.30)"""),
    "pure_patients": Query(
        pure_patients,
        f"""{_C} SELECT c_name AS sample_id, c_custkey AS patient_id FROM customer
            WHERE c_custkey IN (
              SELECT patient_id FROM analysis_set a JOIN purity p
                ON a.analysis_set_id = p.analysis_set_id WHERE purity > 0.9)"""),
    "convert_ids": Query(
        convert, f"{_C} SELECT a.biosample_id AS wgs_id, b.biosample_id AS methylation_id {_PAIRS}"),
    "sibling_ids": Query(
        siblings,
        f"""{_C} SELECT b.biosample_id, b.analysis_set_id, count(*) AS n_requested
            FROM xref a JOIN xref b ON a.analysis_set_id = b.analysis_set_id
            JOIN biosample s ON s.biosample_id = a.biosample_id
            JOIN biosample t ON t.biosample_id = b.biosample_id
            WHERE s.biosample_status = 'tumour' AND t.sample_type = 'methylation'
            GROUP BY 1, 2"""),
    "sample_projection": Query(
        projection,
        """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
           WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""),
    "diagnosis_list": Query(diagnosis_list, "SELECT c_mktsegment FROM customer"),
    "patient_samples": Query(
        patient_samples,
        """SELECT o_orderkey AS sample_id FROM orders
           WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)"""),
    "all_methylation_ids": Query(
        all_methylation_ids, f"{_C} SELECT b.biosample_id AS sample_id, count(*) AS n_requested {_PAIRS} GROUP BY 1"),
    "classifier_join": Query(
        classifier_join,
        """SELECT c_custkey AS "Sample_sample_id", c_custkey AS "Sample_meth_sample_id",
             o_custkey AS "CuratedMethylation_sample_id",
             o_orderkey % 25 AS "CuratedMethylation_meth_group_id",
             o_totalprice AS "CuratedMethylation_meth_class_score",
             n_nationkey AS "MethylationGroup_meth_group_id",
             n_regionkey AS "MethylationGroup_meth_classifier_id",
             n_name AS "MethylationGroup_group_name",
             r_regionkey AS "MethylationClassifier_meth_classifier_id",
             r_name AS "MethylationClassifier_name"
           FROM customer JOIN orders ON o_custkey = c_custkey
           JOIN nation ON n_nationkey = o_orderkey % 25
           JOIN region ON r_regionkey = n_regionkey"""),
    "flattened_rows": Query(
        flattened,
        """SELECT n_nationkey AS nation, s_acctbal, n_name AS name
           FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "classifier_pivot": Query(
        pivot,
        "SELECT user_id AS sample_id, " + ", ".join(
            f"""coalesce(arg_min(props, event_id) FILTER (WHERE event_type = '{k}'
                AND event_id % 2 = {v - 1}), '-') AS "call_{k}_v{v}" """
            for k in ("click", "error", "purchase", "signup", "view") for v in (1, 2))
        + " FROM events GROUP BY 1"),
}
