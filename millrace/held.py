"""Tables that several parts of a query read: written once to a shared folder, so that a lost executor costs no recomputation."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share. The cluster names it in spark.checkpoint.dir; only a local
    session without that setting (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Python and the driver's JVM collect what nothing refers to any more: with it Spark drops the shuffle files of finished
    writes, which otherwise stay on the disks until the driver happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
