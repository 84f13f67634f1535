"""Chaos-game frequency matrices as sparse (x, y) cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import superkmers


def cells(seqs: DataFrame, k: int, *by: str, seq: str = "seq") -> DataFrame:
    """(by, x, y, n): the most recent base is the least significant bit of both coordinates."""
    c = superkmers.counts(seqs, k, *by, seq=seq)
    # of the two bits of each base the upper ones, or the lower ones
    bits = lambda up: sum((F.shiftright("code", 2 * j + up).bitwiseAND(F.lit(1)) * 2**j for j in range(1, k)), F.shiftright("code", up).bitwiseAND(F.lit(1)))
    return c.select(*by, bits(1).alias("x"), bits(0).alias("y"), "n")


def normalised(cell: DataFrame, *by: str) -> DataFrame:
    part = [F.col(c) for c in by] or [F.lit(1)]
    return cell.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*part)))


def l1(cell: DataFrame, pair: str = "pair_id", side: str = "which") -> DataFrame:
    """L1 distance of both sides' matrices per pair, 0 to 2."""
    p = normalised(cell, pair, side)
    both = p.groupBy(pair, "x", "y").agg(F.sum(F.when(F.col(side) == "orig", F.col("p")).otherwise(-F.col("p"))).alias("d"))
    return both.groupBy(pair).agg(F.sum(F.abs("d")).alias("l1_fcgr"))


def joint_l1(joint: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The same from a pair's joint spectrum, with the total k-mers of both sides; a side without k-mers counts as an empty matrix."""
    totals = joint.groupBy(pair).agg(F.sum(F.col("orig") * F.col("n")).alias("orig_total_kmers"), F.sum(F.col("syn") * F.col("n")).alias("syn_total_kmers"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"{c}_total_kmers")), F.lit(0.0))
    rows = joint.join(totals, pair).groupBy(pair, "orig_total_kmers", "syn_total_kmers")
    return rows.agg(F.sum(F.abs(share("orig") - share("syn")) * F.col("n")).alias("l1_fcgr"))


def pair_rows(seqs: DataFrame, k: int, pair: str = "pair_id", side: str = "which", seq: str = "seq", joint: DataFrame | None = None) -> DataFrame:
    """The result row of each pair: status, lengths of all letters, total k-mers and the L1 distance; null where a side is missing.

    ``joint`` is the joint spectrum, if it is there already.
    """
    lengths = seqs.groupBy(pair).agg(*(F.sum(F.when(F.col(side) == s, F.length(seq))).alias(f"{s}_len") for s in ("orig", "syn")))
    found = joint_l1(joint if joint is not None else superkmers.joint_spectrum(seqs, k, pair, side, seq), pair)
    both = F.col("orig_len").isNotNull() & F.col("syn_len").isNotNull()
    j = lengths.join(found, pair, "left").withColumn("status", F.when(both, "ok").otherwise("missing_fasta"))
    return j.select(
        pair, "status", "orig_len", "syn_len", *(F.when(both, F.coalesce(c, F.lit(0))).alias(c) for c in ("orig_total_kmers", "syn_total_kmers")),
        F.when(both, F.coalesce("l1_fcgr", F.lit(0.0))).alias("l1_fcgr"),
    )


def mean_matrix(cell: DataFrame, entity: str, *by: str) -> DataFrame:
    """Mean probability of each cell over all entities of a group; absent cells count as zero."""
    p = normalised(cell, *by, entity)
    n = cell.groupBy(*by).agg(F.count_distinct(entity).alias("entities"))
    return p.groupBy(*by, "x", "y").agg(F.sum("p").alias("_s")).join(F.broadcast(n), [*by]).select(*by, "x", "y", (F.col("_s") / F.col("entities")).alias("p"))


def log_ratio(means: DataFrame, k: int, side: str = "which", eps: float = 1e-6) -> DataFrame:
    """log2((orig + eps) / (syn + eps)) for every cell of the full grid."""
    side_of = lambda s: F.coalesce(F.sum(F.when(F.col(side) == s, F.col("p"))), F.lit(0.0)).alias(s)
    grid = means.sparkSession.range(4**k).select((F.col("id") % 2**k).alias("x"), F.floor(F.col("id") / 2**k).alias("y"))
    m = grid.join(means.groupBy("x", "y").agg(side_of("orig"), side_of("syn")), ["x", "y"], "left").fillna(0.0, ["orig", "syn"])
    return m.withColumn("log2_ratio", F.log2((F.col("orig") + eps) / (F.col("syn") + eps)))


def histogram(values: DataFrame, value: str, bins: int = 15) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed: (bin, n)."""
    lo, hi = F.min(value).over(W.partitionBy(F.lit(1))), F.max(value).over(W.partitionBy(F.lit(1)))
    at = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / (hi - lo) * bins))).otherwise(0).cast("int")
    return values.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
