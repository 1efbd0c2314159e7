"""Registered queries: incremental ingest, batch and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as vf
from ..operators import ingest, probemap, qc
from ..session import scratch_path
from ..streaming import ingest as stream
from . import standins as st
from .probes import collapse_sql
from .registry import Query

KINDS = ["click", "error", "purchase", "signup", "view"]
SUFFIXES = ["_methylation_anno_hg38.txt", "_methylation_anno.txt"]


def _names(spark, d):
    """Customers as file paths: two known endings, an unknown one, marked or not."""
    c = st.table(spark, d, "customer")
    k = F.col("c_custkey")
    stem = (F.when(k % 3 == 0, F.concat(F.lit("P"), k.cast("string"), F.lit("_7_T_M")))
            .when(k % 3 == 1, F.concat(F.lit("06-"), F.lpad((k % 10000).cast("string"), 4, "0"),
                                       F.lit("_T_M")))
            .otherwise(F.concat(F.lit("x"), k.cast("string"))))
    end = F.when(k % 4 < 2, SUFFIXES[0]).when(k % 4 == 2, SUFFIXES[1]).otherwise(".csv")
    return c.select("c_custkey", F.concat(F.lit("/in/"), stem, end).alias("path"))


def sample_names(spark, d):
    s = vf.sibling_names(F.col("path"))
    return ingest.name_files(_names(spark, d), SUFFIXES).select(
        "c_custkey", "meth_sample_id", vf.patient_id(vf.base_name("path")).alias("patient_id"),
        vf.methylation_name("path").alias("meth_file_name"), s["sample_name"].alias("sample_name"),
        s["meth_name"].alias("meth_name"))


def _orders(spark, d):
    return st.table(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderkey").alias("meth_sample_id"))


def _lines(spark, d, flag):
    return st.table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(
        F.col("l_orderkey").alias("meth_sample_id"))


def new_files(spark, d):
    return ingest.new_files(_orders(spark, d), _lines(spark, d, "A"), _lines(spark, d, "N"))


def _poor(spark, d):
    return st.table(spark, d, "customer").filter("c_acctbal < 5000").select(
        F.col("c_custkey").alias("meth_sample_id"))


def _customers_with_orders(spark, d):
    return st.table(spark, d, "orders").select(F.col("o_custkey").alias("meth_sample_id"))


def new_samples(spark, d):
    return ingest.new_samples(_customers_with_orders(spark, d), _poor(spark, d))


def attach_ids(spark, d):
    sample = st.table(spark, d, "customer").select(
        F.col("c_custkey").alias("meth_sample_id"), F.col("c_name").alias("sample_id"),
        F.col("c_mktsegment").alias("patient_id"))
    return ingest.attach_ids(new_samples(spark, d), sample)


def append_samples(spark, d):
    """Finished orders are the matrix, all line items arrive, parts with a gene are known."""
    m = st.order_matrix(spark, d).withColumnRenamed("sample_id", "meth_sample_id")
    done = st.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("meth_sample_id"))
    matrix = m.join(done, "meth_sample_id", "left_semi").withColumn("source", F.lit("matrix"))
    return ingest.append_samples(matrix, m, qc.gene_probes(st.part_meta(spark, d)))


def pivot_features(spark, d):
    ev = st.table(spark, d, "events").groupBy(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("probe_id")).agg(
        F.round(F.sum("value"), 4).alias("m_value"))
    return ingest.serving_table(ev, KINDS)


def _shopping(spark, d):
    o = st.table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("sample_id"),
                    F.col("o_orderpriority").alias("probe_id"))
    return rows, rows.select("probe_id").distinct()


def missing_features(spark, d):
    return ingest.missing_features(*_shopping(spark, d))


def missing_summary(spark, d):
    return ingest.missing_summary(missing_features(spark, d)).select(
        "sample_id", "n_missing", F.array_join("missing", ",").alias("missing"))


def latest_freeze(spark, d):
    ev = st.table(spark, d, "events")
    return ingest.latest_freeze(ev.select(
        "event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("freeze")))


def _stream(spark, d, name):
    schema = st.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_ingest(spark, d):
    """Line items arrive as a stream and are collapsed as in the batch query."""
    target = scratch_path(spark, "target")
    raw = st.raw_arrays(spark, d, _stream(spark, d, "lineitem"))
    chosen = probemap.probe_map(st.part_manifest(spark, d))
    stream.ingest_arrays(raw, chosen, target, scratch_path(spark, "progress")).awaitTermination()
    return probemap.collapsed_measure(stream.current(spark, target), "MValue").withColumn(
        "MValue", F.round("MValue", 6))


def stream_new_samples(spark, d):
    target = scratch_path(spark, "target")
    rows = _stream(spark, d, "orders").select(
        F.col("o_custkey").alias("meth_sample_id"), "o_orderkey")
    stream.ingest_new_samples(rows, _poor(spark, d), target,
                              scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).drop("batch_id")


def stream_dedupe(spark, d):
    """One row per user: repeats are dropped as they arrive."""
    target = scratch_path(spark, "target")
    stream.ingest_first(_stream(spark, d, "events").select("user_id"), target,
                        scratch_path(spark, "progress"), "user_id").awaitTermination()
    return spark.read.parquet(target).drop("batch_id")


_STEM = """CASE WHEN c_custkey % 3 = 0 THEN 'P' || CAST(c_custkey AS VARCHAR) || '_7_T_M'
  WHEN c_custkey % 3 = 1 THEN '06-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '_T_M'
  ELSE 'x' || CAST(c_custkey AS VARCHAR) END"""
_END = f"""CASE WHEN c_custkey % 4 < 2 THEN '{SUFFIXES[0]}' WHEN c_custkey % 4 = 2
  THEN '{SUFFIXES[1]}' ELSE '.csv' END"""
_NEW = """SELECT DISTINCT o_custkey AS meth_sample_id FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""
_LACK = """SELECT sample_id, probe_id FROM (SELECT DISTINCT o_custkey AS sample_id FROM orders)
  CROSS JOIN (SELECT DISTINCT o_orderpriority AS probe_id FROM orders)
  EXCEPT SELECT o_custkey, o_orderpriority FROM orders"""

QUERIES = {
    "sample_names": Query(
        sample_names,
        f"""SELECT c_custkey,
              CASE WHEN c_custkey % 4 = 3 THEN 'MysterySample' ELSE {_STEM} END AS meth_sample_id,
              CASE c_custkey % 3 WHEN 0 THEN 'P' || CAST(c_custkey AS VARCHAR)
                WHEN 1 THEN '06-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END
                AS patient_id,
              CASE WHEN c_custkey % 3 = 2 THEN {_STEM} || {_END} ELSE {_STEM} END AS meth_file_name,
              CASE WHEN c_custkey % 3 = 2 THEN {_STEM} || {_END}
                   ELSE replace({_STEM}, '_T_M', '_T_W') END AS sample_name,
              CASE WHEN c_custkey % 3 = 2 THEN {_STEM} || {_END} ELSE {_STEM} END AS meth_name
            FROM customer"""),
    "new_files": Query(
        new_files,
        """SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS meth_sample_id
           FROM orders WHERE o_orderkey NOT IN (
             SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'
             INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')"""),
    "new_samples": Query(new_samples, _NEW),
    "attach_ids": Query(
        attach_ids,
        f"""SELECT meth_sample_id, c_name AS sample_id, c_mktsegment AS patient_id
            FROM ({_NEW}) JOIN customer ON c_custkey = meth_sample_id"""),
    "append_samples": Query(
        append_samples,
        f"""WITH m AS ({st.ORDER_MATRIX}), meta AS ({st.PART_META}),
              done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
              have AS (SELECT * FROM m WHERE sample_id IN (SELECT o_orderkey FROM done))
            SELECT sample_id AS meth_sample_id, probe_id, m_value, 'matrix' AS source FROM have
            UNION ALL
            SELECT sample_id, probe_id, m_value, NULL FROM m
            WHERE sample_id NOT IN (SELECT sample_id FROM have) AND probe_id IN
              (SELECT probe_id FROM meta WHERE gencodebasic_name IS NOT NULL)"""),
    "pivot_features": Query(
        pivot_features,
        "SELECT user_id AS sample_id, " + ", ".join(
            f"""round(sum(value) FILTER (WHERE event_type = '{k}'), 4) AS "{k}" """ for k in KINDS)
        + " FROM events GROUP BY 1"),
    "missing_features": Query(missing_features, _LACK),
    "missing_summary": Query(
        missing_summary,
        f"""SELECT sample_id, count(*) AS n_missing,
              string_agg(probe_id, ',' ORDER BY probe_id) AS missing FROM ({_LACK}) GROUP BY 1"""),
    "latest_freeze": Query(
        latest_freeze,
        """SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS freeze FROM events
           WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)"""),
    "stream_ingest": Query(stream_ingest, collapse_sql("MValue", 6)),
    "stream_new_samples": Query(
        stream_new_samples,
        """SELECT o_custkey AS meth_sample_id, o_orderkey FROM orders
           WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""),
    "stream_dedupe": Query(stream_dedupe, "SELECT DISTINCT user_id FROM events"),
}
