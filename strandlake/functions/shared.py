"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session may lack it, and then gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = "file://" + os.path.join(tempfile.gettempdir(), "strandlake-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and written, for plans that read it several times; it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
