"""Registered queries: quality filters and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qc
from . import standins as st
from .registry import Query

MAX_MISSING = 1


def gene_probes(spark, d):
    return qc.keep_probes(st.order_matrix(spark, d), qc.gene_probes(st.part_meta(spark, d)))


def drop_xym(spark, d):
    return qc.drop_probes(st.order_matrix(spark, d),
                          qc.chromosome_probes(st.part_meta(spark, d)))


def drop_blacklist(spark, d):
    bad = qc.blacklisted(st.part_blacklist(spark, d), qc.SNP_ADJACENT, qc.CROSS_HYBRIDISING)
    return qc.drop_probes(st.order_matrix(spark, d), bad)


def long_filter(spark, d):
    meta = st.part_meta(spark, d)
    return qc.filter_long(st.order_matrix(spark, d), qc.chromosome_probes(meta),
                          qc.gene_probes(meta))


def problem_samples(spark, d):
    return qc.drop_sparse_samples(st.vector_matrix(spark, d), 0)


def sample_gaps(spark, d):
    return qc.missing_per_sample(st.order_matrix(spark, d), absent_is_missing=True)


def complete_probes(spark, d):
    return qc.drop_incomplete_probes(st.vector_matrix(spark, d))


def complete_repeats(spark, d):
    """Complete probes of a matrix in which most pairs repeat."""
    sample, probe = F.col("l_suppkey") % 20, F.col("l_partkey") % 50
    m = st.table(spark, d, "lineitem").select(
        sample.alias("sample_id"), probe.alias("probe_id"),
        F.when((sample + probe) % 31 != 0, F.col("l_quantity")).alias("m_value"))
    return qc.complete_probes(m)


def filtered_cohort(spark, d):
    return qc.filter_cohort(st.order_matrix(spark, d), st.part_meta(spark, d),
                            st.part_blacklist(spark, d), MAX_MISSING)


def report(spark, d):
    return qc.qc_report(st.order_matrix(spark, d), st.part_meta(spark, d),
                        st.part_blacklist(spark, d), MAX_MISSING)


def unpivot_matrix(spark, d):
    """Wide sums per user back to one row per (user, event type)."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    ev = st.table(spark, d, "events")
    wide = ev.groupBy("user_id").pivot("event_type", kinds).agg(F.round(F.sum("value"), 4))
    return wide.unpivot(["user_id"], kinds, "probe_id", "m_value")


_M = f"m AS ({st.ORDER_MATRIX}), meta AS ({st.PART_META}), bad AS ({st.PART_BLACKLIST})"
_GENE = "probe_id IN (SELECT probe_id FROM meta WHERE gencodebasic_name IS NOT NULL)"
_XYM = "probe_id IN (SELECT probe_id FROM meta WHERE chr_hg38 IN ('chrX', 'chrY', 'chrM'))"
_BAD = "probe_id IN (SELECT probe_id FROM bad WHERE reason = '{}')"
_STEPS = f"""{_M},
  f1 AS (SELECT * FROM m WHERE {_GENE}),
  f2 AS (SELECT * FROM f1 WHERE NOT {_XYM}),
  f3 AS (SELECT * FROM f2 WHERE sample_id IN (
           SELECT sample_id FROM f2 GROUP BY sample_id
           HAVING count(*) - count(m_value) <= {MAX_MISSING})),
  f4 AS (SELECT * FROM f3 WHERE NOT {_BAD.format('Polymorphism')}),
  f5 AS (SELECT * FROM f4 WHERE NOT {_BAD.format('CrossHybridization')})"""


def _step(i: int, name: str, a: str, b: str) -> str:
    return f"""
    SELECT CAST({i} AS INTEGER) AS step, '{name}' AS step_name,
      (SELECT count(DISTINCT sample_id) FROM {a}) AS samples_before,
      (SELECT count(DISTINCT sample_id) FROM {b}) AS samples_after,
      (SELECT count(DISTINCT probe_id) FROM {a}) AS probes_before,
      (SELECT count(DISTINCT probe_id) FROM {b}) AS probes_after"""


_ORDER_FLAGS = """SELECT l_suppkey % 20 AS sample_id, l_partkey % 50 AS probe_id,
  CASE WHEN (l_suppkey % 20 + l_partkey % 50) % 31 <> 0 THEN l_quantity END AS m_value
  FROM lineitem"""
_REPORT = f"""WITH {_STEPS} SELECT *, samples_before - samples_after AS samples_removed,
  probes_before - probes_after AS probes_removed FROM (""" + " UNION ALL ".join(
    _step(i, n, a, b) for i, n, a, b in [
        (1, "Gene-Associated Probe Filtering", "m", "f1"),
        (2, "XYM Probe Filtering", "f1", "f2"),
        (3, "Problem Sample Filtering", "f2", "f3"),
        (4, "SNP Adjacent Probe Filtering", "f3", "f4"),
        (5, "Cross-Hybridization Probe Filtering", "f4", "f5")]) + ")"

QUERIES = {
    "qc_report": Query(report, _REPORT),
    "qc_gene_probes": Query(gene_probes, f"WITH {_M} SELECT * FROM m WHERE {_GENE}"),
    "qc_drop_xym": Query(drop_xym, f"WITH {_M} SELECT * FROM m WHERE NOT {_XYM}"),
    "qc_drop_blacklist": Query(
        drop_blacklist,
        f"WITH {_M} SELECT * FROM m WHERE probe_id NOT IN (SELECT probe_id FROM bad)"),
    "qc_long_filter": Query(
        long_filter, f"WITH {_M} SELECT * FROM m WHERE {_GENE} AND NOT {_XYM}"),
    "qc_problem_samples": Query(
        problem_samples,
        f"""WITH m AS ({st.VECTOR_MATRIX}) SELECT * FROM m WHERE sample_id NOT IN
            (SELECT sample_id FROM m WHERE m_value IS NULL)"""),
    "qc_sample_gaps": Query(
        sample_gaps,
        f"""WITH m AS ({st.ORDER_MATRIX})
            SELECT sample_id, (SELECT count(DISTINCT probe_id) FROM m)
              - count(DISTINCT probe_id) FILTER (m_value IS NOT NULL) AS n_missing
            FROM m GROUP BY sample_id"""),
    "qc_complete_repeats": Query(
        complete_repeats,
        f"""WITH m AS ({_ORDER_FLAGS}),
              pairs AS (SELECT DISTINCT sample_id, probe_id FROM m WHERE m_value IS NOT NULL)
            SELECT probe_id FROM pairs GROUP BY 1
            HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM m)"""),
    "qc_complete_probes": Query(
        complete_probes,
        f"""WITH m AS ({st.VECTOR_MATRIX}) SELECT * FROM m WHERE probe_id NOT IN
            (SELECT probe_id FROM m WHERE m_value IS NULL)"""),
    "qc_filtered_cohort": Query(filtered_cohort, f"WITH {_STEPS} SELECT * FROM f5"),
    "unpivot_matrix": Query(
        unpivot_matrix,
        """WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view'])
                        AS probe_id),
             u AS (SELECT DISTINCT user_id FROM events)
           SELECT u.user_id, k.probe_id, round(sum(value), 4) AS m_value
           FROM u CROSS JOIN k LEFT JOIN events e
             ON e.user_id = u.user_id AND e.event_type = k.probe_id
           GROUP BY 1, 2"""),
}
