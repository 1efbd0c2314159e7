"""The nightly jobs: raw files to measurements, and new samples to the matrix."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import base_name, id_from_file_name
from ..operators import ingest, probemap
from ..session import cut
from ..sources import files

# Fixed value: suffix of the annotated array files.
RAW_SUFFIXES = ("_methylation_anno_hg38.txt",)
#: Files of one turn, on average.
BATCH = 4096


def measure(raw: DataFrame, chosen: DataFrame) -> DataFrame:
    """Both array versions as measurements of the older array's loci."""
    newer = probemap.to_measurements(probemap.collapse(raw.filter("newer"), chosen))
    return newer.unionByName(probemap.pass_through(raw.filter(~F.col("newer"))))


def _held(spark: SparkSession, target: str) -> DataFrame:
    """Ids of the samples that an output holds; none if it is not there yet."""
    if not files.exists(spark, target):
        return spark.createDataFrame([], "meth_sample_id string")
    return spark.read.parquet(target).select("meth_sample_id").distinct()


def extract_new(spark: SparkSession, raw_dir: str, manifest: DataFrame, target: str,
                freeze: str, suffixes=RAW_SUFFIXES, beta_target: str | None = None,
                batch: int = BATCH) -> DataFrame:
    """Normalise the raw files whose samples the outputs do not hold, and append them.

    With ``beta_target`` M values go to ``target`` and Beta values to that second
    output, both by their own ids: a sample that only one of them holds is read
    again and added to the other.  Without it one output has both values.

    Files are taken ``batch`` at a time, so the driver never holds more paths, and a
    run that was ended goes on with the files that are left.  Returns the listing of
    the files that were taken.
    """
    outputs = {target: ["m_value", "beta_value"]} if beta_target is None else \
        {target: ["m_value"], beta_target: ["beta_value"]}
    held = {path: cut(_held(spark, path)) for path in outputs}
    listing = ingest.name_files(files.list_files(spark, raw_dir, suffixes), suffixes)
    listing = cut(ingest.new_files(listing, held[target], held[beta_target or target]))
    turns = math.ceil(listing.count() / batch)
    chosen = probemap.probe_map(manifest)
    for turn in range(turns):
        now = listing.filter(F.pmod(F.xxhash64("path"), F.lit(turns)) == turn).select("path")
        taken = [r["path"] for r in now.collect()]
        if not taken:
            continue
        lines = spark.read.text(taken).select(
            "value", F.col("_metadata.file_path").alias("path"))
        raw = files.parse_arrays(lines).withColumn(
            "sample_id", id_from_file_name(base_name("path"), suffixes))
        rows = cut(measure(raw, chosen))
        for path, values in outputs.items():
            other = [c for c in ("m_value", "beta_value") if c not in values]
            files.write_measurements(rows.drop(*other).join(held[path], "meth_sample_id", "left_anti"),
                                     path, freeze)
    return listing.select("path")


def collect_features(matrix: DataFrame, extracted: DataFrame, sample: DataFrame,
                     features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix with all new samples, and what those samples lack."""
    new = ingest.attach_ids(ingest.new_samples(extracted, matrix), sample)
    rows = extracted.join(new, "meth_sample_id")
    lacking = ingest.missing_summary(ingest.missing_features(rows, features, "meth_sample_id"),
                                     "meth_sample_id")
    return ingest.append_samples(matrix, rows.select(*[
        c for c in matrix.columns if c in rows.columns]), features), lacking
