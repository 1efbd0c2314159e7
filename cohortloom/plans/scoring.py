"""Registered queries: evaluation tables and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev, impute
from . import standins as st
from .registry import Query


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def confusion(spark, d):
    return ev.confusion(st.calls(spark, d))


def metrics(spark, d):
    return _rounded(ev.class_metrics(st.calls(spark, d)), "sensitivity", "specificity",
                    "youden_index", "balanced_accuracy")


def report(spark, d):
    return _rounded(ev.class_report(st.calls(spark, d)), "precision", "recall", "f1_score")


def share(spark, d):
    return _rounded(ev.share_above(st.table(spark, d, "events"), "value", 20.0, ("event_type",)),
                    "share")


def roc_points(spark, d):
    """The start point's threshold, infinity, is shown as null."""
    points = ev.roc_points(st.class_scores(spark, d))
    points = points.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))
    return _rounded(points, "threshold", "fpr", "tpr")


def roc_auc(spark, d):
    return _rounded(ev.roc_auc(st.class_scores(spark, d)), "auc")


def binary(spark, d):
    return _rounded(ev.binary_scores(st.scored_labels(spark, d)), "accuracy", "brier_score",
                    "roc_auc")


def histogram(spark, d):
    return ev.correct_calls(st.certainties(spark, d))


def quartiles(spark, d):
    """Five numbers of the correct calls of each class, on columns of their own."""
    q = ev.correct_call_quartiles(st.certainties(spark, d))
    return q.select("class", "n", *[F.round(F.get("quartiles", F.lit(i)), 9).alias(name)
                                    for i, name in enumerate(("least", "q1", "median", "q3", "most"))])


def mean_fill(spark, d):
    return _rounded(impute.impute_mean(st.vector_matrix(spark, d)), "m_value")


def knn_fill(spark, d):
    filled = impute.impute_knn(st.vector_matrix(spark, d))
    return _rounded(filled.filter("imputed").drop("imputed"), "m_value")


_COUNTS = f"""WITH calls AS ({st.CALLS}),
  classes AS (SELECT actual AS class FROM calls UNION SELECT predicted FROM calls),
  counts AS (
    SELECT class, count(*) FILTER (actual = class AND predicted = class) AS tp,
      count(*) FILTER (actual <> class AND predicted = class) AS fp,
      count(*) FILTER (actual = class AND predicted <> class) AS fn,
      count(*) FILTER (actual <> class AND predicted <> class) AS tn,
      count(*) FILTER (actual = class) AS support
    FROM classes CROSS JOIN calls GROUP BY 1)"""
_SAFE = "coalesce({} / nullif({}, 0), 0)".format
_SENS, _SPEC = _SAFE("tp", "tp + fn"), _SAFE("tn", "tn + fp")
_STEPS = f"""WITH s AS ({st.CLASS_SCORES}),
  g AS (SELECT class, score, count(*) FILTER (actual = class) AS pos,
               count(*) FILTER (actual <> class) AS neg FROM s GROUP BY 1, 2),
  c AS (SELECT *, sum(pos) OVER up AS cp, sum(neg) OVER up AS cn, sum(pos) OVER al AS tp,
               sum(neg) OVER al AS tn
        FROM g WINDOW up AS (PARTITION BY class ORDER BY score DESC),
                      al AS (PARTITION BY class))"""

QUERIES = {
    "confusion": Query(
        confusion, f"SELECT actual, predicted, count(*) AS n FROM ({st.CALLS}) GROUP BY 1, 2"),
    "confusion_metrics": Query(
        metrics,
        f"""{_COUNTS} SELECT class, tp, fp, fn, tn, round({_SENS}, 6) AS sensitivity,
            round({_SPEC}, 6) AS specificity, round({_SENS} + {_SPEC} - 1, 6) AS youden_index,
            round({_SENS}, 6) AS balanced_accuracy FROM counts"""),
    "class_report": Query(
        report,
        f"""{_COUNTS},
          r AS (SELECT class, {_SAFE('tp', 'tp + fp')} AS precision,
                  {_SAFE('tp', 'support')} AS recall,
                  {_SAFE('2 * tp', '2 * tp + fp + fn')} AS f1_score, support, tp FROM counts),
          a AS (
            SELECT class, precision, recall, f1_score, support FROM r
            UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support),
              sum(tp) / sum(support), sum(support) FROM r
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score),
              sum(support) FROM r
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
              sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
              sum(support) FROM r)
          SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
                 round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM a"""),
    "share_above": Query(
        share,
        """SELECT event_type, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS share
           FROM events GROUP BY 1"""),
    "roc_points": Query(
        roc_points,
        f"""{_STEPS} SELECT class, round(score, 6) AS threshold, round(cn / tn, 6) AS fpr,
            round(cp / tp, 6) AS tpr FROM c
            UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM c"""),
    "roc_auc": Query(
        roc_auc,
        f"""{_STEPS}, l AS (
              SELECT class, cn / tn AS x, cp / tp AS y,
                coalesce(lag(cn / tn) OVER w, 0) AS x0, coalesce(lag(cp / tp) OVER w, 0) AS y0
              FROM c WINDOW w AS (PARTITION BY class ORDER BY score DESC))
            SELECT class, round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM l GROUP BY 1"""),
    "binary_scores": Query(
        binary,
        f"""WITH s AS ({st.SCORED_LABELS}),
              flat AS (SELECT split, avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0
                                         ELSE 0.0 END) AS accuracy,
                              avg((probability - label) ** 2) AS brier_score FROM s GROUP BY 1),
              auc AS (SELECT p.split, avg(CASE WHEN p.probability > n.probability THEN 1.0
                        WHEN p.probability = n.probability THEN 0.5 ELSE 0.0 END) AS roc_auc
                      FROM s p JOIN s n ON p.split = n.split AND p.label = 1 AND n.label = 0
                      GROUP BY 1)
            SELECT flat.split, round(accuracy, 6) AS accuracy, round(brier_score, 6) AS brier_score,
                   round(roc_auc, 6) AS roc_auc FROM flat JOIN auc ON auc.split = flat.split"""),
    "correct_call_hist": Query(
        histogram,
        f"""SELECT predicted AS class, CAST(least(floor(p * 10) + 1, 10) AS INTEGER) AS bin,
              count(*) AS n, min(p) AS lowest, max(p) AS highest FROM (
              SELECT *, ((sample_id * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM ({st.CALLS}))
            WHERE actual = predicted GROUP BY 1, 2"""),
    "correct_call_quartiles": Query(
        quartiles,
        f"""SELECT predicted AS class, count(*) AS n, round(min(p), 9) AS least,
              round(quantile_cont(p, 0.25), 9) AS q1, round(quantile_cont(p, 0.5), 9) AS median,
              round(quantile_cont(p, 0.75), 9) AS q3, round(max(p), 9) AS most FROM (
              SELECT *, ((sample_id * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM ({st.CALLS}))
            WHERE actual = predicted GROUP BY 1"""),
    "impute_mean": Query(
        mean_fill,
        f"""WITH m AS ({st.VECTOR_MATRIX})
            SELECT sample_id, probe_id, round(coalesce(m_value,
                     avg(m_value) OVER (PARTITION BY probe_id)), 6) AS m_value,
                   m_value IS NULL AS imputed FROM m"""),
    "impute_knn": Query(
        knn_fill,
        f"""WITH m AS ({st.VECTOR_MATRIX}),
              gaps AS (SELECT sample_id, probe_id FROM m WHERE m_value IS NULL),
              dist AS (
                SELECT a.sample_id AS t, b.sample_id AS d,
                  round(sqrt(64.0 / count(*) * sum((a.m_value - b.m_value) ** 2)), 9) AS dist
                FROM m a JOIN m b ON a.probe_id = b.probe_id
                WHERE a.m_value IS NOT NULL AND b.m_value IS NOT NULL
                  AND a.sample_id IN (SELECT sample_id FROM gaps) GROUP BY 1, 2),
              near AS (
                SELECT g.sample_id, g.probe_id, m.m_value AS v, row_number() OVER (
                  PARTITION BY g.sample_id, g.probe_id ORDER BY dist, d) AS rn
                FROM gaps g JOIN dist ON t = g.sample_id
                JOIN m ON m.sample_id = d AND m.probe_id = g.probe_id
                WHERE m.m_value IS NOT NULL)
            SELECT sample_id, probe_id, round(avg(v), 6) AS m_value FROM near WHERE rn <= 5
            GROUP BY 1, 2"""),
}
