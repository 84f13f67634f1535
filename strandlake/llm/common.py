"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, for Java and Python regular expressions.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only a local session may lack it; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    path = "file://" + os.path.join(tempfile.gettempdir(), "strandlake-shared")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back.

    It cuts the lineage, survives lost executors and keeps later steps from
    computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._strandlake_path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: Column) -> Column:
    """The words of a text, in order; null counts as an empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many groups of about ``per_task`` rows, and no fewer than Spark's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


#: Stands for a null id inside the operators, so that such rows have a place in every order.
NULL_ID = -(2**63)


def id_in(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_out(col: str) -> Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col)).alias(col)


def per_process(key: str, make: Callable):
    """What ``make`` returns, made once in a Python worker and kept for its later tasks.

    Task functions are pickled by value, so their module's globals don't outlive a task; a module of the worker's own does.
    """
    kept = sys.modules.setdefault("_strandlake_kept", ModuleType("_strandlake_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
