"""Registered queries: probe mapping between array versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probemap as pm
from . import standins as st
from .registry import Query


def replicates(spark, d):
    return pm.replicate_counts(st.part_manifest(spark, d))


def histogram(spark, d):
    return pm.replicate_histogram(st.part_manifest(spark, d))


def selected(spark, d):
    return pm.probe_map(st.part_manifest(spark, d))


def selected_lists(spark, d):
    return pm.probe_lists(pm.probe_map(st.part_manifest(spark, d))).select(
        "EPICv1locmatch", F.array_join("IlmnID", ",").alias("IlmnID"))


def unresolved(spark, d):
    return pm.unresolved(st.part_manifest(spark, d))


def collapsed(spark, d):
    return pm.collapse(st.raw_arrays(spark, d), pm.probe_map(st.part_manifest(spark, d)))


def collapse_m(spark, d):
    return pm.collapsed_measure(collapsed(spark, d), "MValue").withColumn(
        "MValue", F.round("MValue", 6))


def collapse_beta(spark, d):
    return pm.collapsed_measure(collapsed(spark, d), "Beta").withColumn(
        "Beta", F.round("Beta", 6))


def collapse_first(spark, d):
    raw = st.raw_arrays(spark, d)
    # Line numbers repeat in the stand-in, so the probe and price break ties.
    order = F.struct("line_no", "Name", "Beta", "MValue")
    return pm.first_per_locus(raw.withColumn("at", order), "at")


def pass_through(spark, d):
    return pm.pass_through(st.raw_arrays(spark, d))


def collapse_sql(measure: str, digits: int) -> str:
    """The row-by-row rule: replace mapped loci, keep distinct, drop split loci."""
    return f"""WITH raw AS ({st.RAW_ARRAYS}), map AS ({st.PROBE_MAP}),
      rows AS (SELECT * FROM raw WHERE "EPICv1_Loci" IS NOT NULL),
      means AS (SELECT sample_id, "EPICv1locmatch" AS locus, avg("{measure}") AS mean
                FROM rows JOIN map ON "Name" = "IlmnID" GROUP BY 1, 2),
      replaced AS (
        SELECT DISTINCT r.sample_id, "EPICv1_Loci" AS probe_id,
               CASE WHEN m.locus IS NOT NULL THEN mean ELSE "{measure}" END AS v
        FROM rows r LEFT JOIN means m
          ON m.sample_id = r.sample_id AND m.locus = "EPICv1_Loci")
      SELECT sample_id, probe_id, round(any_value(v), {digits}) AS "{measure}"
      FROM replaced GROUP BY 1, 2 HAVING count(*) = 1"""


QUERIES = {
    "probe_replicates": Query(
        replicates,
        f"""SELECT "EPICv1locmatch", count("EPICv1locmatch") AS n_replicates
            FROM ({st.PART_MANIFEST}) GROUP BY 1"""),
    "probe_replicate_histogram": Query(
        histogram,
        f"""SELECT n_replicates, count("EPICv1locmatch") AS n_loci FROM (
              SELECT "EPICv1locmatch", count("EPICv1locmatch") AS n_replicates
              FROM ({st.PART_MANIFEST}) GROUP BY 1) GROUP BY 1"""),
    "probe_select": Query(selected, st.PROBE_MAP),
    "probe_lists": Query(
        selected_lists,
        f"""SELECT "EPICv1locmatch", string_agg("IlmnID", ',' ORDER BY "IlmnID") AS "IlmnID"
            FROM ({st.PROBE_MAP}) GROUP BY 1"""),
    "probe_unresolved": Query(
        unresolved,
        f"""WITH man AS ({st.PART_MANIFEST})
            SELECT "EPICv1locmatch", "IlmnID" FROM man
            WHERE "EPICv1locmatch" IN (
                SELECT "EPICv1locmatch" FROM man GROUP BY 1
                HAVING count("EPICv1locmatch") IN (2, 3, 4, 5, 6, 10))
              AND "EPICv1locmatch" NOT IN (SELECT "EPICv1locmatch" FROM ({st.PROBE_MAP}))"""),
    "collapse_probes": Query(collapse_m, collapse_sql("MValue", 6)),
    "collapse_probes_beta": Query(collapse_beta, collapse_sql("Beta", 6)),
    "pass_through": Query(
        pass_through,
        f"""SELECT sample_id AS meth_sample_id, "Name" AS probe_id, "MValue" AS m_value,
              "Beta" AS beta_value FROM ({st.RAW_ARRAYS})"""),
    "collapse_first": Query(
        collapse_first,
        f"""SELECT sample_id, "EPICv1_Loci" AS probe_id, "MValue" AS m_value FROM (
              SELECT *, row_number() OVER (PARTITION BY sample_id, "EPICv1_Loci"
                ORDER BY line_no, "Name", "Beta", "MValue" NULLS FIRST) AS rn
              FROM ({st.RAW_ARRAYS}) WHERE "EPICv1_Loci" IS NOT NULL) WHERE rn = 1"""),
}
