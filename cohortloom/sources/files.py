"""Readers and writers of the cohort's files."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.values import base_name, clean_number
from ..session import cut

log = logging.getLogger(__name__)

ID_COLUMNS = ("sample_id", "meth_sample_id", "sampleId")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names; nothing is listed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def safely(read, default=None):
    """Run a reader; an absent or bad file gives ``default`` and a warning."""
    try:
        return read()
    except PySparkException as error:
        log.warning("could not read: %s", error)
        return default


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Wide sample-by-probe CSV as long rows; None with a warning if absent.

    A matrix has one column per probe, far too many for a wide DataFrame, so
    lines are split and exploded and the header becomes a (position, probe)
    table.  Nulls stay as rows.  The older id column name is accepted.
    """
    lines = safely(lambda: spark.read.text(path))
    if lines is None:
        return None
    cells = F.transform(F.split("value", ",", -1), lambda c: F.trim(c, F.lit(' "\r')))
    rows = lines.select(cells.alias("cells"))
    first = F.get("cells", F.lit(0))
    names = rows.filter(first.isin(*ID_COLUMNS)).select(
        F.posexplode("cells").alias("pos", "probe_id")).distinct()
    names = cut(names.withColumn("probe_id", F.when(
        F.col("probe_id") == "sampleId", "sample_id").otherwise(F.col("probe_id"))))
    ids = {r["probe_id"]: r["pos"] for r in names.filter(
        F.col("probe_id").isin("sample_id", "meth_sample_id")).collect()}
    data = rows.filter(~first.isin(*ID_COLUMNS))
    keys = [F.get("cells", F.lit(ids[k])).alias(k) if k in ids
            else F.lit(None).cast("string").alias(k) for k in ("sample_id", "meth_sample_id")]
    long = data.select(*keys, F.posexplode("cells").alias("pos", "text"))
    return long.join(names.filter(~F.col("probe_id").isin("sample_id", "meth_sample_id")),
                     "pos").select("sample_id", "meth_sample_id", "probe_id",
                                   clean_number("text").alias("m_value"))


def read_dimension_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Probe metadata, manifest or blacklist: header by name, ``NA`` and empty are null."""
    fields = schemas.schema(ddl).fields
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return raw.select(*[
        (F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None))
        .try_cast(f.dataType).alias(f.name) for f in fields])


def list_files(spark: SparkSession, directory: str, suffixes) -> DataFrame:
    """All files below a directory that end in one of the suffixes; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    name = base_name("path")
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.endswith(name, F.lit(suffix))
    return listing.select("path", "modificationTime", "length").filter(wanted)


def _lines(spark: SparkSession, directory: str, suffixes) -> DataFrame:
    glob = "*{" + ",".join(suffixes) + "}"
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(
        directory).select("value", F.col("_metadata.file_path").alias("path"))


def parse_arrays(lines: DataFrame) -> DataFrame:
    """Raw array rows out of the lines of many tab-separated files.

    Columns are found by each file's own header, so both array versions and any
    column order come out of one pass: a file with ``EPICv1_Loci`` is of the
    newer version.  Files without an ``MValue`` column give no rows.
    """
    fields = F.transform(F.split("value", "\t", -1), lambda c: F.trim(c, F.lit(' "\r')))
    rows = lines.select("path", fields.alias("cells"))
    # A cheap text test first, so that this pass splits next to no lines.
    likely = lines.filter(F.contains("value", F.lit("MValue"))).select(
        "path", fields.alias("cells"))
    is_header = F.array_contains("cells", "MValue") & F.array_contains("cells", "Name")
    at = lambda name: F.array_position("cells", name).cast("int") - 1
    headers = cut(likely.filter(is_header).select(
        "path", at("Name").alias("i_name"), at("EPICv1_Loci").alias("i_locus"),
        at("MValue").alias("i_m"), at("Beta").alias("i_beta")))
    cell = lambda i: F.when(F.col(i) >= 0, F.nullif(F.get("cells", F.col(i)), F.lit("NA")))
    return rows.filter(~is_header).join(headers, "path").select(
        "path", cell("i_name").alias("Name"), cell("i_locus").alias("EPICv1_Loci"),
        (F.col("i_locus") >= 0).alias("newer"), clean_number(cell("i_m")).alias("MValue"),
        clean_number(cell("i_beta")).alias("Beta"))


def read_arrays(spark: SparkSession, directory: str, suffixes) -> DataFrame:
    return parse_arrays(_lines(spark, directory, suffixes))


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    """Nested JSON with an explicit schema; None with a warning if absent."""
    return safely(lambda: spark.read.schema(schemas.schema(ddl)).option(
        "multiLine", True).json(path))


def read_model_params(spark: SparkSession, directory: str) -> DataFrame:
    """Parameter records, the model's name taken from ``model-<name>.json``."""
    raw = spark.read.schema(schemas.schema(schemas.MODEL_PARAMS)).option("multiLine", True).option(
        "pathGlobFilter", "model-*.json").json(directory)
    name = F.regexp_extract(base_name(F.col("_metadata.file_path")), r"^model-(.*?)\.json$", 1)
    return raw.select(F.url_decode(name).alias("model_name"), "*")


def read_table(spark: SparkSession, name: str, path: str | None = None,
               jdbc: dict | None = None) -> DataFrame:
    """A clinical table or tree relation, from Parquet or over JDBC."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    ddl = {"tree_edges": schemas.TREE_EDGES, "tree_samples": schemas.TREE_SAMPLES,
           **schemas.CLINICAL}[name]
    return spark.read.schema(schemas.schema(ddl)).parquet(f"{path}/{name}.parquet")


def write_measurements(m: DataFrame, path: str, freeze: str, mode: str = "append") -> None:
    """Rows of one snapshot, sorted by probe inside each file so that a probe
    filter can skip row groups."""
    m.withColumn("freeze", F.lit(freeze)).sortWithinPartitions("probe_id").write.mode(
        mode).partitionBy("freeze").parquet(path)


def write_sample_files(m: DataFrame, path: str, column: str) -> None:
    """Per-sample CSV folders of (probeName, value).

    Rows of a sample are brought together first, so that a folder is a few files;
    a sample with very many rows is split over several writers.
    """
    m.select("meth_sample_id", F.col("probe_id").alias("probeName"), F.col(column)).filter(
        F.col(column).isNotNull()).hint("rebalance", "meth_sample_id").write.mode(
        "overwrite").partitionBy("meth_sample_id").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def select_base(spark: SparkSession, output_path: str, frozen_path: str) -> DataFrame:
    """The updated matrix if it has been written, else the frozen one."""
    path = output_path if exists(spark, output_path) else frozen_path
    return spark.read.parquet(path)
