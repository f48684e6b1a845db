"""Storage that driver and executors share, for tables that a lost executor must not take along."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set, a temporary folder serves a local master; a cluster has none and is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sluice-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Computed once, written to the shared folder and cut from its lineage.

    Spark deletes the files once nothing refers to them, unless the session says otherwise.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    context._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)
