"""Session building, lineage cuts and shared scratch space."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_roots: set[str] = set()


def build_session(app_name: str = "cohortloom", **conf) -> SparkSession:
    """A session with the settings the jobs rely on; the caller's settings win.

    Broadcasts are left to Catalyst and AQE, which compare measured sizes with
    the threshold, and skewed sort-merge joins are split by AQE.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Their Python workers import it for the few UDFs; the driver's own import path
    does not reach them.  Spark serves the archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="cohortloom-")) / "cohortloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the cluster names none and all runs in this process (tests on one
    machine) is a temporary folder made and set; elsewhere executors would write
    to disks of their own, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not local_master(context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortloom-"))
    return named or context.getCheckpointDir()


def local_master(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def application_root(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's process ends."""
    context = spark.sparkContext
    root = f"{checkpoint_root(spark).rstrip('/')}/cohortloom-{context.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(discard, spark, root)
    return root


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables; a session already ended is left alone."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone
        pass


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The result has no lineage to recompute when executors are lost, and unlike
    an RDD checkpoint it is computed once, is pruned by column and has a known
    size for the join planner.  With ``partition_by`` a later filter on that
    column reads only its own folder.
    """
    path = scratch_path(df.sparkSession, "cut")
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is written yet."""
    return f"{application_root(spark)}/{uuid.uuid4().hex}/{name}"


def shared_uri(path: str) -> str:
    """A path of the shared folder as a URI."""
    return path if urlsplit(path).scheme else f"file://{path}"


def put_array(root: str, name: str, array: np.ndarray) -> None:
    """Write an array to a file of the shared folder, whole under another name and then under its own:
    a task that is run again replaces it by the same bytes."""
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    draft = f"{path}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
    files.move(draft, f"{path}/{name}")


def map_array(root: str, name: str, dtype) -> np.ndarray:
    """The array, mapped and not read; a store without paths is copied to an unnamed local file first."""
    files, path = fs.FileSystem.from_uri(root)
    if not files.get_file_info(f"{path}/{name}").size:
        return np.zeros(0, dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with tempfile.TemporaryFile() as copy, files.open_input_stream(f"{path}/{name}") as data:
        while piece := data.read(1 << 22):
            copy.write(piece)
        copy.flush()
        return np.memmap(copy, dtype, "r")
