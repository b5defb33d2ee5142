"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="transitmill-")
    return _local[app]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, in whichever file system it lies."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
