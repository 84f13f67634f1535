"""Length bins and balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.shared import settled


def pooled(rows: DataFrame, group: str = "group", genome: str = "genome_id", length: str = "length") -> DataFrame:
    """One length for each genome of a group, however many rows (motifs, k) it has: the largest, should they differ."""
    return rows.groupBy(group, genome).agg(F.max(length).alias(length))


def quantile_edges(rows: DataFrame, length: str, bins: int) -> DataFrame:
    """One row with the array of the bins + 1 quantiles of the lengths, without the dust of interpolation."""
    edges = F.percentile(F.col(length), F.array(*(F.lit(i / bins) for i in range(bins + 1))))
    return rows.agg(edges.alias("edges")).select(F.transform("edges", lambda x: F.round(x, 9)).alias("edges"))


def truncated(rows: DataFrame, length: str, bins: int) -> DataFrame:
    """bin by truncated edges, the last one raised by one; the last edge at or below a length decides."""
    e = quantile_edges(rows, length, bins).select(F.transform("edges", lambda x: x.cast("long")).alias("e"))
    e = e.select(F.concat(F.slice("e", 1, bins), F.array(F.element_at("e", bins + 1) + 1)).alias("e"))
    at = F.size(F.filter("e", lambda x: x <= F.col(length))) - 1
    return rows.crossJoin(F.broadcast(e)).withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), at))).drop("e")


def contiguous(rows: DataFrame, length: str, bins: int) -> DataFrame:
    """Inclusive whole-number ranges (bin, lo, hi): rounded edges, pushed apart where they overlap."""
    e = quantile_edges(rows, length, bins).select(F.transform("edges", lambda x: F.bround(x, 0).cast("long")).alias("e"))
    step = lambda a, i: F.concat(
        a,
        F.array(F.struct(
            F.when(i == 0, F.get("e", F.lit(0))).otherwise(F.element_at(a, -1)["hi"] + 1).alias("lo"),
            F.greatest(F.when(i == 0, F.get("e", F.lit(0))).otherwise(F.element_at(a, -1)["hi"] + 1), F.get("e", i + 1) - F.when(i == bins - 1, 0).otherwise(1)).alias("hi"),
        )),
    )
    ranges = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.array().cast("array<struct<lo: bigint, hi: bigint>>"), step)
    return e.select(F.posexplode(ranges).alias("bin", "r")).select("bin", "r.lo", "r.hi")


def cut(rows: DataFrame, length: str, bins: int) -> DataFrame:
    """bin by unique quantile edges, the last one raised by one, right-closed, the first one closed on both sides: bin, L_lo and L_hi."""
    e = quantile_edges(rows, length, bins).select(F.array_distinct("edges").alias("e"))
    e = e.select(F.concat(F.slice("e", 1, F.greatest(F.lit(1), F.size("e") - 1)), F.array(F.element_at("e", -1) + 1)).alias("e"))
    x = F.col(length)
    at = F.when(x == F.get("e", F.lit(0)), 1).otherwise(F.size(F.filter("e", lambda v: v < x)))
    out = rows.crossJoin(F.broadcast(e)).withColumn("_at", at)
    return out.select(*rows.columns, (F.col("_at") - 1).alias("bin"), F.get("e", F.col("_at") - 1).cast("long").alias("L_lo"), F.get("e", F.col("_at")).cast("long").alias("L_hi"))


def manifest(binned: DataFrame, group: str, groups: list[str], bins: int) -> DataFrame:
    """Rows of each group in every bin, empty bins included."""
    grid = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = binned.groupBy("bin").agg(*(F.count_if(F.col(group) == g).alias(f"n_{g}") for g in groups))
    return grid.join(n, "bin", "left").fillna(0)


def balanced(rows: DataFrame, group: str, key: str, seed: int, *by: str) -> DataFrame:
    """As many rows of each group as the smaller one has, within ``by``, in an order fixed by the seed."""
    r = stats.hash_places(rows, seed, key, *by, group).withColumnRenamed("_m", "_own")
    n = rows.groupBy(*by, group).count().groupBy(*by).agg(F.min("count").alias("_least"), F.count(group).alias("_groups"))
    r = stats.joined(r, n, [*by]) if by else r.crossJoin(F.broadcast(n))  # one row
    return r.where((F.col("_groups") == 2) & (F.col("_r") <= F.col("_least"))).drop("_r", "_own", "_least", "_groups")


def gated(rows: DataFrame, group: str, least: int, *by: str) -> DataFrame:
    """Only the bins in which both groups have at least ``least`` rows."""
    n = rows.groupBy(*by, group).count().groupBy(*by).agg(F.min("count").alias("_m"), F.count("*").alias("_g")).where((F.col("_m") >= least) & (F.col("_g") == 2))
    return rows.join(n.select(*by), [*by], "left_semi")


def delta_intervals(rows: DataFrame, value: str, group: str, order: str, reps: int, seed: int, *by: str) -> DataFrame:
    """Mean difference synthetic minus natural per ``by`` with a percentile bootstrap interval, groups drawn independently."""
    point = rows.groupBy(*by).agg((F.avg(F.when(F.col(group) == "synthetic", F.col(value))) - F.avg(F.when(F.col(group) == "natural", F.col(value)))).alias("delta_mean"))
    b = stats.bootstrap(rows, value, order, reps, seed, *by, group).groupBy(*by, "rep", group).agg(F.avg(value).alias("m"))
    d = b.groupBy(*by, "rep").agg((F.sum(F.when(F.col(group) == "synthetic", F.col("m"))) - F.sum(F.when(F.col(group) == "natural", F.col("m")))).alias("d"))
    return point.join(d.groupBy(*by).agg(F.percentile("d", F.lit(0.025)).alias("delta_lo"), F.percentile("d", F.lit(0.975)).alias("delta_hi")), [*by])


def bin_stats(rows: DataFrame, value: str, key: str, reps: int, seed: int, *by: str, least: int = 10) -> DataFrame:
    """Of (group, value) in each ``by``: both groups gated, made equally large, their mean difference with its interval, and its p and q.

    Rows of synthetic against natural; q over all rows of the table.
    """
    even = settled(balanced(gated(settled(rows), "grp", least, *by), "grp", key, seed, *by))
    n = even.groupBy(*by).agg(F.count_if(F.col("grp") == "natural").alias("n_natural"), F.count_if(F.col("grp") == "synthetic").alias("n_synthetic"))
    delta = delta_intervals(even, value, "grp", key, reps, seed, *by)
    p = stats.mann_whitney_p(even, value, F.col("grp") == "synthetic", *by).select(*by, "p")
    return stats.bh(n.join(delta, [*by]).join(p, [*by]), "p", tie=by)


def overall_stats(rows: DataFrame, value: str, key: str, reps: int, seed: int, bin_by: tuple[str, ...], *by: str, least: int = 10) -> DataFrame:
    """The same over all bins of a ``by`` together, each bin gated and balanced first."""
    even = settled(balanced(gated(settled(rows), "grp", least, *bin_by), "grp", key, seed, *bin_by))
    n = even.groupBy(*by).agg(F.count_if(F.col("grp") == "natural").alias("n_natural"), F.count_if(F.col("grp") == "synthetic").alias("n_synthetic"))
    delta = delta_intervals(even, value, "grp", key, reps, seed, *by)
    p = stats.mann_whitney_p(even, value, F.col("grp") == "synthetic", *by).select(*by, "p")
    return stats.bh(n.join(delta, [*by]).join(p, [*by]), "p", tie=by)
