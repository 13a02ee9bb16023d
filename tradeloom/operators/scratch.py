"""Intermediate tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_LOCK = Lock()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only where all tasks run in this process."""
    with _LOCK:
        root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
        if root is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"set {_SETTING} to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tradeloom-", dir="/tmp")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tradeloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no frame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    Used where a frame feeds several jobs: the lineage ends at the files, so a lost
    executor costs a re-read, and later scans read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
