"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made in this process, by application.
_made: dict[str, list[str]] = {}


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base and spark.sparkContext.master.startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="chartloom-")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    path = f"{shared_base(spark)}/chartloom-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read back: what several later steps use is computed once, and outlives its executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the shared folders made so far by this application; call it when no result that reads them is needed any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    return len(paths)
