"""Stored k-mer sets: codes written once for each genome and k, merged without a shuffle.

A set table is bucketed and sorted by the code, the same for every genome, so
the same k-mers of any two genomes lie in buckets of one number.  Intersection
and both differences are then merges of equal buckets; only sums leave them.
A table of (genome columns, k, code) is partitioned by k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nullomers, superkmers


def write(seqs: DataFrame, ks: list[int], name: str, *genome: str, seq: str = "seq", buckets: int | None = None) -> DataFrame:
    """Writes the canonical k-mer sets of every genome as table ``name``, and reads it; the one shuffle by code is here."""
    spark = seqs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mode = "error"
    for k in sorted(set(ks)):
        codes = superkmers.counts(seqs, k, *genome, seq=seq, canonical=True).select(*genome, F.lit(k).alias("k"), "code")
        codes.repartition(n, "code").write.partitionBy("k").bucketBy(n, "code").sortBy("code").mode(mode).saveAsTable(name)
        mode = "append"
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def presence(sets: DataFrame, pair: str = "pair_id", side: str = "which") -> DataFrame:
    """(pair, k, code, in_orig, in_syn): the full outer merge of both sides of every pair, bucket by bucket."""
    return sets.groupBy(pair, "k", "code").agg(F.max(F.col(side) == "orig").alias("in_orig"), F.max(F.col(side) == "syn").alias("in_syn"))


def merged(left: DataFrame, right: DataFrame, k: int, how: str) -> DataFrame:
    """Codes of two genomes' rows of one table at one k: ``inner`` for shared ones, ``left_anti`` for those that only the left has."""
    of_k = lambda df: df.where(F.col("k") == k).select("code").hint("merge")
    return of_k(left).join(of_k(right), "code", how)


def pair_metrics(sets: DataFrame, pair: str = "pair_id", side: str = "which") -> DataFrame:
    """Unique, shared, missing and novel k-mers with their rates, for each pair and k."""
    return nullomers.metrics_by(presence(sets, pair, side), pair, "k")


def fractions(sets: DataFrame, genomes: DataFrame, ks: list[int], *genome: str) -> DataFrame:
    """Every genome at every k, those without k-mers included: distinct k-mers, the space, and its unused part."""
    n = sets.groupBy(*genome, "k").agg(F.count("*").alias("_n"))
    grid = genomes.select(*genome).distinct().select(*genome, F.explode(F.array(*map(F.lit, sorted(set(ks))))).alias("k"))
    one = grid.join(n, [*genome, "k"], "left").select(*genome, "k", F.coalesce("_n", F.lit(0)).alias("observed_distinct_kmers"))
    return nullomers.with_space(one)


def k_list(ks: list[int] | None, least: int, most: int) -> list[int]:
    """The explicit list, sorted and without repeats, or else all from ``least`` to ``most``."""
    return sorted(set(ks)) if ks else list(range(least, most + 1))
