"""Registered queries: splits, node data sets and differential methylation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds, differential as dm, qc, tree
from . import standins as st
from .registry import Query

MIN_CLASS = 50
TOP = 10


def class_tree(spark, d):
    held = st.class_samples(spark, d)
    nodes = tree.build_tree(st.class_edges(spark, d), held, st.CLASS_ROOT)
    return nodes, tree.node_samples(nodes, held)


def place_tree(spark, d):
    held = st.place_samples(spark, d)
    nodes = tree.build_tree(st.place_edges(spark, d), held, st.ROOT)
    return nodes, tree.node_samples(nodes, held)


def split_leafwise(spark, d):
    return ds.split_leafwise(*class_tree(spark, d), unit=st.spread())


def split_rollup(spark, d):
    nodes, held = class_tree(spark, d)
    rolled = ds.roll_up(nodes, ds.split_leafwise(nodes, held, unit=st.spread()))
    return rolled.groupBy("node_id", "split").agg(F.count(F.lit(1)).alias("n"))


def split_stratified(spark, d):
    return ds.split_stratified(*place_tree(spark, d), unit=st.spread())


def split_random(spark, d):
    o = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return ds.split_random(o, unit=st.spread())


def folds(spark, d):
    o = st.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("label"))
    return ds.assign_folds(o, "label", 3, unit=st.spread())


def _summary(long):
    return long.groupBy("node_id", "cancer_type").agg(
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("probe_id").alias("n_probes"),
        F.count("m_value").alias("n_values"), F.round(F.sum("m_value"), 6).alias("total"))


def node_design(spark, d):
    m = st.vector_matrix(spark, d)
    design = ds.node_design(m, *class_tree(spark, d), min_class=MIN_CLASS)
    return _summary(ds.node_matrix(qc.drop_incomplete_probes(m), design))


def node_design_other(spark, d):
    m = st.vector_matrix(spark, d)
    design = ds.cohort_design(m, *class_tree(spark, d), min_class=MIN_CLASS)
    return _summary(ds.node_matrix(m, design, ds.cohort_probes(m, design)))


def node_design_rows(spark, d):
    m = st.vector_matrix(spark, d)
    design = ds.cohort_design(m, *class_tree(spark, d), min_class=MIN_CLASS)
    return _summary(ds.node_matrix(m, ds.drop_gappy_samples(m, design)))


def moments(spark, d):
    m = st.vector_matrix(spark, d, gaps=False)
    return dm.design_moments(m, ds.node_design(m, *class_tree(spark, d)))


def diff_pooled_t(spark, d):
    fits = dm.probe_tests(moments(spark, d), "none")
    return fits.select("node_id", "cancer_type", "probe_id", "n", "n_rest",
                       F.round("diff", 8).alias("diff"), F.round("s2", 8).alias("s2"),
                       F.round("t", 6).alias("t"))


def diff_top_probes(spark, d):
    return dm.select_probes(moments(spark, d), "none", TOP)


def diff_moderated(spark, d):
    fits = dm.probe_tests(moments(spark, d), "eb")
    return dm.top_probes(fits).select("node_id", "cancer_type", "probe_id", "rank",
                                      F.round("t", 6).alias("t"))


def diff_robust(spark, d):
    fits = dm.probe_tests(moments(spark, d), "robust")
    return dm.top_probes(fits).select("node_id", "cancer_type", "probe_id", "rank",
                                      F.round("d0", 4).alias("d0"), F.round("t", 6).alias("t"))


def diff_selected_matrix(spark, d):
    m = st.vector_matrix(spark, d)
    m = qc.keep_probes(m, qc.complete_probes(m))  # as the search: no sample is lost
    design = ds.node_design(m, *class_tree(spark, d))
    root = ds.node_matrix(m, design.filter(F.col("node_id") == st.CLASS_ROOT))
    model = dm.DifferentialSelector().fit(root)
    return model.transform(root).select("sample_id", "probe_id", "m_value")


def scaled_features(spark, d):
    """Each probe centred and divided by its population deviation."""
    m = st.vector_matrix(spark, d, gaps=False)
    stats = m.groupBy("probe_id").agg(F.avg("m_value").alias("mu"),
                                      F.stddev_pop("m_value").alias("sd"))
    return m.join(stats, "probe_id").select(
        "sample_id", "probe_id", F.round((F.col("m_value") - F.col("mu")) / F.col("sd"), 6)
        .alias("scaled"))


_U = st.SPREAD
_LEAF = f"""
  leaf AS (SELECT 'R/G' || CAST(label % 3 AS VARCHAR) || '/C' || CAST(label AS VARCHAR) AS node_id,
                  vec_id AS sample_id FROM embeddings),
  leaf_split AS (
    SELECT node_id, sample_id, CASE WHEN
      row_number() OVER (PARTITION BY node_id ORDER BY {_U}, sample_id)
        <= greatest(1, floor(count(*) OVER (PARTITION BY node_id) * 0.2))
      THEN 'validation' ELSE 'training' END AS split FROM leaf)"""
_BIG = f"""
  design AS ({st.CLASS_DESIGN}),
  big AS (SELECT node_id, cancer_type FROM design GROUP BY 1, 2 HAVING count(*) >= {MIN_CLASS}),
  labelled AS (SELECT d.* FROM design d JOIN big USING (node_id, cancer_type)),
  others AS (
    SELECT d.node_id, sample_id,
           CASE WHEN b.node_id IS NULL THEN 'otherCancerType' ELSE d.cancer_type END AS cancer_type
    FROM design d LEFT JOIN big b
      ON b.node_id = d.node_id AND b.cancer_type = d.cancer_type)"""
_SUM = """SELECT node_id, cancer_type, count(DISTINCT sample_id) AS n_samples,
  count(DISTINCT probe_id) AS n_probes, count(m_value) AS n_values,
  round(sum(m_value), 6) AS total"""


def _kept(rel: str) -> str:
    return f"""{rel} WHERE node_id IN (SELECT node_id FROM {rel} GROUP BY 1
      HAVING count(*) >= 10 AND count(DISTINCT cancer_type) >= 2)"""


_T = f"""WITH m AS ({st.VECTOR_FULL}), design AS ({st.CLASS_DESIGN}),
  classes AS (SELECT DISTINCT node_id, cancer_type AS c FROM design),
  parts AS (
    SELECT d.node_id, c, probe_id,
      count(*) FILTER (cancer_type = c) AS n, count(*) FILTER (cancer_type <> c) AS n_rest,
      avg(m_value) FILTER (cancer_type = c) - avg(m_value) FILTER (cancer_type <> c) AS diff,
      var_pop(m_value) FILTER (cancer_type = c) AS v1,
      var_pop(m_value) FILTER (cancer_type <> c) AS v2
    FROM design d JOIN classes k ON k.node_id = d.node_id JOIN m USING (sample_id)
    GROUP BY 1, 2, 3),
  fits AS (SELECT *, (v1 * n + v2 * n_rest) / (n + n_rest - 2) AS s2 FROM parts),
  tests AS (SELECT *, diff / sqrt(s2 * (1.0 / n + 1.0 / n_rest)) AS t FROM fits)"""

QUERIES = {
    "split_leafwise": Query(split_leafwise, f"WITH {_LEAF} SELECT * FROM leaf_split"),
    "split_rollup": Query(
        split_rollup,
        f"""WITH {_LEAF} SELECT node_id, split, count(*) AS n FROM (
              SELECT node_id, split FROM leaf_split
              UNION ALL SELECT regexp_extract(node_id, '^R/G[0-9]+'), split FROM leaf_split
              UNION ALL SELECT 'R', split FROM leaf_split) GROUP BY 1, 2"""),
    "split_stratified": Query(
        split_stratified,
        f"""WITH RECURSIVE {st.PLACE_NODES},
          pick AS (SELECT c.parent_id AS node_id, c.name AS label, sample_id FROM nodes c
                   JOIN ups ON ancestor_id = c.node_id JOIN held ON held.node_id = descendant_id
                   WHERE distance = 0 OR c.node_id NOT IN (SELECT node_id FROM held)),
          sized AS (SELECT node_id, label, count(*) AS n FROM pick WHERE node_id IS NOT NULL
                    GROUP BY 1, 2 HAVING count(*) >= 2),
          quota AS (
            SELECT *, ceil(0.2 * sum(n) OVER w) AS n_test,
                   n * ceil(0.2 * sum(n) OVER w) / sum(n) OVER w AS exact,
                   count(*) OVER w AS classes
            FROM sized WINDOW w AS (PARTITION BY node_id)),
          dealt AS (
            SELECT node_id, label, floor(exact) + CASE WHEN
              row_number() OVER (PARTITION BY node_id
                                 ORDER BY round(exact - floor(exact), 9) DESC, label)
                <= n_test - sum(floor(exact)) OVER (PARTITION BY node_id) THEN 1 ELSE 0 END AS q
            FROM quota WHERE classes > 1),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY node_id, label
                       ORDER BY {_U}, sample_id) AS rn FROM pick)
          SELECT r.node_id, r.label, sample_id FROM ranked r JOIN dealt d
            ON d.node_id = r.node_id AND d.label = r.label WHERE rn <= q"""),
    "split_random": Query(
        split_random,
        f"""SELECT sample_id, row_number() OVER (ORDER BY {_U}, sample_id)
              <= ceil(0.2 * count(*) OVER ()) AS held_out
            FROM (SELECT o_orderkey AS sample_id FROM orders)"""),
    "folds": Query(
        folds,
        f"""SELECT sample_id, label, CAST((row_number() OVER (
              ORDER BY label, {_U}, sample_id) - 1) % 3 AS INTEGER) AS fold
            FROM (SELECT o_orderkey AS sample_id, o_orderpriority AS label FROM orders)"""),
    "node_design": Query(
        node_design,
        f"""WITH m AS ({st.VECTOR_MATRIX}), {_BIG},
              good AS (SELECT probe_id FROM m GROUP BY 1 HAVING count(*) = count(m_value))
            {_SUM} FROM (SELECT * FROM {_kept('labelled')}) JOIN m USING (sample_id)
            WHERE probe_id IN (SELECT probe_id FROM good) GROUP BY 1, 2"""),
    "node_design_other": Query(
        node_design_other,
        f"""WITH m AS ({st.VECTOR_MATRIX}), {_BIG},
              kept AS (SELECT * FROM {_kept('others')}),
              long AS (SELECT * FROM kept JOIN m USING (sample_id)),
              good AS (SELECT node_id, probe_id FROM long GROUP BY 1, 2
                       HAVING count(*) = count(m_value))
            {_SUM} FROM long JOIN good USING (node_id, probe_id) GROUP BY 1, 2"""),
    "node_design_rows": Query(
        node_design_rows,
        f"""WITH m AS ({st.VECTOR_MATRIX}), {_BIG},
              kept AS (SELECT * FROM {_kept('others')})
            {_SUM} FROM kept JOIN m USING (sample_id)
            WHERE sample_id NOT IN (SELECT sample_id FROM m WHERE m_value IS NULL)
            GROUP BY 1, 2"""),
    "diff_pooled_t": Query(
        diff_pooled_t,
        f"""{_T} SELECT node_id, c AS cancer_type, probe_id, n, n_rest, round(diff, 8) AS diff,
            round(s2, 8) AS s2, round(t, 6) AS t FROM tests"""),
    "diff_top_probes": Query(
        diff_top_probes,
        f"""{_T} SELECT DISTINCT node_id, probe_id FROM (
              SELECT *, row_number() OVER (PARTITION BY node_id, c
                ORDER BY round(abs(t), 9) DESC, probe_id) AS rn FROM tests) WHERE rn <= {TOP}"""),
    "diff_moderated": Query(diff_moderated),
    "diff_robust": Query(diff_robust),
    "diff_selected_matrix": Query(diff_selected_matrix),
    "scaled_features": Query(
        scaled_features,
        f"""WITH m AS ({st.VECTOR_FULL}), s AS (
              SELECT probe_id, avg(m_value) AS mu, stddev_pop(m_value) AS sd FROM m GROUP BY 1)
            SELECT sample_id, probe_id, round((m_value - mu) / sd, 6) AS scaled
            FROM m JOIN s USING (probe_id)"""),
}
