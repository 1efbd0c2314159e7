"""Finding new files and samples, and appending them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.values import base_name, id_from_file_name
from ..session import cut

#: Features that one row of the search for missing ones holds, on average.
SLICE = 1024


def name_files(files: DataFrame, suffixes, path: str = "path") -> DataFrame:
    """File listing with the sample id read from each file name."""
    return files.withColumn("meth_sample_id", id_from_file_name(base_name(path), suffixes))


def new_files(files: DataFrame, m_outputs: DataFrame, beta_outputs: DataFrame) -> DataFrame:
    """Files whose M and Beta outputs do not both exist."""
    done = m_outputs.select("meth_sample_id").join(
        beta_outputs.select("meth_sample_id"), "meth_sample_id", "left_semi")
    return files.join(done, "meth_sample_id", "left_anti")


def new_samples(available: DataFrame, matrix: DataFrame) -> DataFrame:
    """Ids with extracted values that the matrix does not have yet."""
    return available.select("meth_sample_id").distinct().join(
        matrix.select("meth_sample_id"), "meth_sample_id", "left_anti")


def attach_ids(new: DataFrame, sample: DataFrame, key: str = "meth_sample_id") -> DataFrame:
    """Sample and patient of each new id; ids unknown to the table fall away."""
    return new.join(sample.select(key, "sample_id", "patient_id"), key)


def append_samples(matrix: DataFrame, new: DataFrame, features: DataFrame,
                   key: str = "meth_sample_id") -> DataFrame:
    """The matrix with the new samples' rows of known features.

    Samples that are already there are skipped; columns only one side has are
    null on the other.  The ids that are there are written first, so that no task
    sorts for the matrix's own joins and for this one at a time.
    """
    there = cut(matrix.select(key).distinct())
    fresh = new.join(features, "probe_id", "left_semi").join(there, key, "left_anti")
    return matrix.unionByName(fresh, allowMissingColumns=True)


def serving_table(m: DataFrame, features: list[str], index: str = "sample_id") -> DataFrame:
    """One row per sample, one column per selected feature, null where absent."""
    return m.filter(F.col("probe_id").isin(features)).groupBy(index).pivot(
        "probe_id", features).agg(F.first("m_value", ignorenulls=True))


def missing_features(new: DataFrame, features: DataFrame, key: str = "sample_id") -> DataFrame:
    """(sample, probe) for every known feature a new sample lacks.

    The features are cut into hash slices of about ``SLICE``.  Per sample and slice
    the set of features it has is gathered, and the slice minus that set is what it
    lacks, so that no row holds more than one slice of the list.
    """
    wanted = cut(features.select("probe_id").filter("probe_id is not null").distinct())
    n = math.ceil(wanted.count() / SLICE)
    if not n:
        return new.select(key, "probe_id").limit(0)
    part = F.pmod(F.xxhash64("probe_id"), F.lit(n)).cast("int").alias("slice")
    slices = wanted.groupBy(part).agg(F.collect_list("probe_id").alias("all"))
    has = new.join(wanted, "probe_id", "left_semi").groupBy(key, part).agg(
        F.collect_set("probe_id").alias("has"))
    empty = F.array().cast(f"array<{features.schema['probe_id'].dataType.simpleString()}>")
    asked = new.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    return asked.join(slices, "slice").join(has, [key, "slice"], "left").select(
        key, F.explode(F.array_except("all", F.coalesce("has", empty))).alias("probe_id"))


def missing_summary(missing: DataFrame, key: str = "sample_id") -> DataFrame:
    """Number and sorted list of missing features per sample."""
    return missing.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_missing"),
        F.sort_array(F.collect_list("probe_id")).alias("missing"))


def latest_freeze(table: DataFrame) -> DataFrame:
    """Rows of the newest snapshot."""
    return table.filter(F.col("freeze") == table.agg(F.max("freeze").alias("f")).scalar())
