"""Tables written between the steps of a job, in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so a folder of this machine is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's setting; one of our own, removed at the end, only in local mode."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not is_local(spark):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"slovomer-{spark.sparkContext.applicationId}")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = "file://" + path
    return folder.rstrip("/")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint in the shared folder.

    Spark removes the files with the table if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)
