"""Registered queries: near graph, neighbourhood embedding, projection of new samples."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import functions as F

from ..operators import neighbourhood as nb
from . import standins as st
from .registry import Query

_fits: dict[tuple[str, str], nb.Neighbourhoods] = {}
_lock = Lock()


def near_graph(spark, d):
    """The nearest of every vector; exact while one block holds them all."""
    rows = nb.points(st.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("vec")))
    return nb.near_graph(rows).select("sample_id", F.posexplode("near").alias("pos", "n")).select(
        "sample_id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("near_id"),
        F.round("n.d", 5).alias("d"))


def _cohort(spark, d):
    """The embedding of the cohort, the samples that suppliers name, once per application and data."""
    key = (spark.sparkContext.applicationId, d)
    with _lock:
        if key not in _fits:
            m = st.vector_matrix(spark, d)
            weights = m.select(F.lit("cohort").alias("model"), "probe_id",
                               F.lit(1.0).alias("importance")).distinct()
            named = st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"))
            _fits[key] = nb.fit_neighbourhoods(m, named, weights, "cohort")
        return _fits[key]


def neighbourhood_embedding(spark, d):
    return _cohort(spark, d).placed


def neighbourhood_projection(spark, d):
    """The cohort where it lies, and all other samples that know its probes among it."""
    m = st.vector_matrix(spark, d)
    return _cohort(spark, d).project(m, m.select("sample_id"))


QUERIES = {
    "near_graph": Query(
        near_graph,
        """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
             p AS (SELECT a.vec_id AS sample_id, b.vec_id AS near_id,
                     list_distance(a.v, b.v) * list_distance(a.v, b.v) AS d
                   FROM e a JOIN e b ON a.vec_id <> b.vec_id)
           SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY d, near_id)
                    AS INTEGER) AS rank, near_id, round(d, 5) AS d
           FROM p QUALIFY rank <= 15"""),
    "neighbourhood_embedding": Query(neighbourhood_embedding),
    "neighbourhood_projection": Query(neighbourhood_projection),
}
