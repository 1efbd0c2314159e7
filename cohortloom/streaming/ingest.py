"""Array files as a stream: each is normalised and appended exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import probemap
from ..sources.files import exists

#: Folders by sample that a batch's raw rows are laid in.
BUCKETS = 64
_BUCKET, _BATCH = T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())


def append_once(batch: DataFrame, batch_id: int, target: str, key: str = "sample_id") -> None:
    """Append a batch's samples that no other batch has written.

    A replayed batch overwrites its own folder, so running it again changes
    nothing.  The ids of each batch are kept beside the target, one row per
    sample, so that the test reads those and not the measurements; no state is
    held in the stream.
    """
    spark, ids = batch.sparkSession, f"{target.rstrip('/')}_ids"
    fresh = batch
    if exists(spark, ids):
        schema = T.StructType([batch.schema[key], T.StructField("batch_id", T.LongType())])
        before = spark.read.schema(schema).parquet(ids).filter(F.col("batch_id") != batch_id)
        fresh = batch.join(before, key, "left_anti")
    folder = f"{target}/batch_id={batch_id}"
    fresh.write.mode("overwrite").parquet(folder)
    spark.read.schema(batch.schema).parquet(folder).select(key).distinct().write.mode(
        "overwrite").parquet(f"{ids}/batch_id={batch_id}")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("sample_id"), F.lit(BUCKETS)).cast("int")


def _ids(landed: str) -> str:
    return f"{landed}_ids"


def land_rows(rows: DataFrame, batch_id: int, landed: str) -> tuple[DataFrame, DataFrame]:
    """Write a batch's raw rows, a folder per bucket of samples; a replay overwrites them.

    Returns the rows as written, and their samples, which are kept beside them: a
    row per batch and sample, in the same buckets.  Rows without a sample are left out.
    """
    spark, schema = rows.sparkSession, T.StructType([*rows.schema, _BUCKET])
    folder, ids = f"{landed}/batch_id={batch_id}", f"{_ids(landed)}/batch_id={batch_id}"
    rows.filter("sample_id is not null").withColumn("bucket", _bucket()).hint(
        "rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    now = spark.read.schema(schema).parquet(folder)
    now.select("sample_id", "bucket").distinct().write.mode("overwrite").partitionBy(
        "bucket").parquet(ids)
    return now.drop("bucket"), spark.read.schema(
        T.StructType([rows.schema["sample_id"], _BUCKET])).parquet(ids)


def landed_before(rows: DataFrame, touched: DataFrame, batch_id: int, landed: str) -> DataFrame | None:
    """What earlier batches landed of the samples of this one; None if they hold none.

    The samples kept per batch, read in the touched buckets only, name the (batch,
    bucket) folders to open, and no other folder is listed or read.  Their names, as
    many as folders are opened, are all that comes to the driver.
    """
    spark, key = rows.sparkSession, rows.schema["sample_id"]
    buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    held = spark.read.schema(T.StructType([key, _BATCH, _BUCKET])).parquet(_ids(landed)).filter(
        (F.col("batch_id") < batch_id) & F.col("bucket").isin(buckets))
    folders = [f"{landed}/batch_id={r['batch_id']}/bucket={r['bucket']}" for r in held.join(
        touched, ["sample_id", "bucket"], "left_semi").select("batch_id", "bucket").distinct().collect()]
    if not folders:
        return None
    past = spark.read.schema(T.StructType([*rows.schema, _BATCH, _BUCKET])).option(
        "basePath", landed).parquet(*sorted(folders))
    return past.join(touched, ["sample_id", "bucket"], "left_semi").select(*rows.columns)


def ingest_arrays(raw: DataFrame, chosen: DataFrame, target: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Land each arriving batch of raw rows and collapse the samples it touches anew.

    Raw rows lie beside the target, a folder per batch that a replay overwrites.
    A sample whose rows come in several batches is collapsed from all that has
    landed of it, so the answer does not hang on how the input is cut; what other
    samples have landed is not read.  :func:`current` reads the answer.  ``prepare``
    turns a batch into raw rows first, for example lines of text files.
    ``availableNow`` takes what is there and stops.
    """
    landed = f"{target.rstrip('/')}_raw"

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        whole, touched = land_rows(rows, batch_id, landed)
        past = landed_before(whole, touched, batch_id, landed)
        if past is not None:
            whole = whole.unionByName(past)
        probemap.collapse(whole, chosen).write.mode("overwrite").parquet(
            f"{target}/batch_id={batch_id}")

    return raw.writeStream.foreachBatch(land).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str = "sample_id") -> DataFrame:
    """The newest rows of every sample that :func:`ingest_arrays` has written."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [key, "batch_id"], "left_semi").drop("batch_id")


def ingest_new_samples(rows: DataFrame, known: DataFrame, target: str, checkpoint: str,
                       key: str = "meth_sample_id") -> StreamingQuery:
    """Append rows of samples that the matrix did not hold at the start.

    Each batch is written to a folder of its own, which a replay overwrites; a
    sample's rows may come in any number of batches.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.join(known.select(key), key, "left_anti").write.mode("overwrite").parquet(
            f"{target}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(land).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_first(rows: DataFrame, target: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Append one row per sample, the first time it arrives; no state is held in the stream."""

    def land(batch: DataFrame, batch_id: int) -> None:
        append_once(batch.dropDuplicates([key]), batch_id, target, key)

    return rows.writeStream.foreachBatch(land).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(rows: DataFrame, key: str, arrival: str, delay: str = "1 day") -> DataFrame:
    """Repeats of a sample that arrive within ``delay`` of each other are dropped."""
    timed = rows.withColumn(arrival, F.col(arrival).cast("timestamp"))
    return timed.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])
