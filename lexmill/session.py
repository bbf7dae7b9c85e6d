"""Sessions and checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where neither that nor a checkpoint folder is set, a new local one in local mode (tests), and an error on a cluster, whose machines don't share such a folder."""
    sc = spark.sparkContext
    if (kept := sc.getCheckpointDir()) is not None:
        return kept
    path = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the checkpoint folder: neither lost executors nor later plans go back further than this."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """For loops of many rounds: what earlier rounds shuffled is removed once the driver's JVM has collected their plans, which it does seldom by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
