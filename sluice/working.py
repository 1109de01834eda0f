"""Working tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests on one machine), a local folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sluice-")


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sluice-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back, so that it is computed once and outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
