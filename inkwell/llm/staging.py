"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Seconds between two collections of the driver's garbage.
_WAIT = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves on a local master (tests);
    on any other master that is an error, since executors on other machines
    could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="inkwell-")
    return f"file://{_LOCAL[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/inkwell-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This computes ``df`` once and cuts its lineage; the files outlive lost
    executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step will read."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back(spark: SparkSession) -> None:
    """Returns memory that the driver no longer uses to the system, and lets
    the engine delete the shuffle files and broadcasts of finished steps.

    What a finished step leaves behind lets go of its shuffles only some time
    after it; a second collection finds those that the first one could not.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(_WAIT)
    spark._jvm.System.gc()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)
