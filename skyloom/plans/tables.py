"""Intermediate tables in the folder all executors share.

A written table cuts the lineage and survives the loss of an executor. Its place
is the cluster's ``spark.checkpoint.dir``; where that is unset on a local master (tests, a laptop)
one temporary folder is made per application and removed at its end; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="skyloom-")
            atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
        folder = _own_folders[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark)}/skyloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the frame once as parquet and read it back.

    For a frame that several jobs use. Unlike a cached frame it does not grow
    executor memory, and its readers still prune columns.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
