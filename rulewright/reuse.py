"""Tables that a plan reads several times."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df, computed once where it is read again: in memory, or on disk beyond it; a lost part is computed anew."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; removed when the application ends.

    Only where the cluster names none, as in tests on one machine, a temporary folder stands in.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not top:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
        top = context.getCheckpointDir()
    folder = f"{top.rstrip('/')}/tables-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it, and their plans don't grow with what made it."""
    folder = shared_folder(df.sparkSession) + "/table"
    df.write.parquet(folder)
    # Spark removes shuffle files once the driver's collectors find their plans unused; a table ends the use of many
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
