"""Runs that can be stopped and resumed: keyed partitions with a sentinel each.

Results are a Parquet table partitioned by its key.  After the partitions of
some keys are written, a line of JSON for each of them is added to the table
of sentinels beside it.  A later run leaves out the keys whose sentinel can be
read; a key whose run was cut short, or whose sentinel is corrupt, is done
again, and its partition is replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SENTINEL = "key string, rows long"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(key, rows) of the keys with a sound sentinel; none if nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sentinels")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SENTINEL)
    lines = spark.read.text(f"{path}/sentinels").select(F.from_json("value", SENTINEL).alias("s"))
    return lines.where("s.key IS NOT NULL AND s.rows IS NOT NULL").groupBy("s.key").agg(F.max("s.rows").alias("rows"))


def run(jobs: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, slices: int = 1) -> DataFrame:
    """Does ``work`` for the jobs whose key (a string, never null) is not finished, slice by slice, and returns the whole table.

    ``work`` keeps the key column.  A slice is some of the keys, by hash: what
    a stopped run loses is at most the slice that it was at.
    """
    spark = jobs.sparkSession
    todo = jobs.join(finished(spark, path).select(F.col("key").alias(key)), key, "left_anti")
    for i in range(slices):
        own = todo.where(F.pmod(F.hash(key), F.lit(slices)) == i)
        keys = own.select(key).distinct()
        result = work(own)
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/results")
        written = spark.read.schema(result.schema).parquet(f"{path}/results")
        count = keys.join(written.groupBy(key).agg(F.count("*").alias("rows")), key, "left").select(F.col(key).alias("key"), F.coalesce("rows", F.lit(0)).alias("rows"))
        count.select(F.to_json(F.struct("key", "rows")).alias("value")).write.mode("append").text(f"{path}/sentinels")
    return results(spark, path, key, result.schema)


def results(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """The rows of all finished keys; those of a key that was cut short don't count."""
    sound = finished(spark, path).select(F.col("key").alias(key))
    return spark.read.schema(schema).parquet(f"{path}/results").join(sound, key, "left_semi").select(*schema.names)
