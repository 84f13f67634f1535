"""Natural against synthetic populations within bins, with intervals from resampled genomes.

A replicate is a set of weights, one for each genome, so that resampling never
copies a spectrum or a matrix before it is summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from . import fcgr


def weights(entities: DataFrame, key: str, reps: int, seed: int, *by: str, balance: tuple[str, ...] | None = None, seed_by: str | None = None) -> DataFrame:
    """How often each entity of a group is drawn with replacement: (by, key, rep, w, drawn); those not drawn are left out.

    A group draws as often as it has entities, or as often as the smallest of
    the groups that share the ``balance`` columns has.  ``seed_by`` is added to
    the seed.
    """
    e = entities.select(*by, key).distinct()
    place = F.row_number().over(W.partitionBy(*by).orderBy(key)) - 1
    e = e.withColumn("_i", place).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    e = e.withColumn("drawn", F.min("_n").over(W.partitionBy(*balance)) if balance else F.col("_n"))
    own = F.lit(seed) + F.col(seed_by) if seed_by else F.lit(seed)
    draws = e.where(F.col("_i") < F.col("drawn")).select(*by, "_i", "_n", "drawn", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(*by, "drawn", "rep", (stats.draw(own, F.col("rep"), F.col("_i")) % F.col("_n")).cast("int").alias("_i"))
    times = draws.groupBy(*by, "drawn", "rep", "_i").agg(F.count("*").alias("w"))
    return times.join(e.select(*by, "_i", key), [*by, "_i"]).drop("_i")


def both_have(entities: DataFrame, least: int, *by: str, group: str = "grp") -> DataFrame:
    """The ``by`` in which both groups have ``least`` genomes or more: (by, n_natural, n_synthetic)."""
    n = entities.groupBy(*by).agg(*(F.count_if(F.col(group) == g).alias(f"n_{g}") for g in ("natural", "synthetic")))
    return n.where((F.col("n_natural") >= least) & (F.col("n_synthetic") >= least))


def _side(value: str, side: str):
    return F.coalesce(F.sum(F.when(F.col("grp") == side, F.col(value))), F.lit(0.0))


def spectra_bins(entities: DataFrame, spectra: DataFrame, key: str, reps: int, seed: int, least: int = 5, x_max: int = 500, balance: bool = True) -> DataFrame:
    """Bootstrap mean cdfs of both groups and their difference in each bin, on the bin's own abundances up to ``x_max``.

    ``entities`` is (bin, grp, key), ``spectra`` (key, x, pmf).  A bin in which a
    group has fewer than ``least`` genomes gives no rows; a genome without k-mers
    counts with an empty spectrum.  Returns bin, x, n_natural, n_synthetic, and of
    nat, syn and delta the mean with its central 95 %; pmf_nat and pmf_syn are the
    means of the whole bin.
    """
    ok = both_have(entities, least, "bin")
    e = entities.select("bin", "grp", key).join(ok, "bin")
    s = e.join(spectra.where(F.col("x").between(1, x_max)).select(key, "x", "pmf"), key)
    point = s.groupBy("bin", "x", "n_natural", "n_synthetic").agg(
        (_side("pmf", "natural") / F.col("n_natural")).alias("pmf_nat"), (_side("pmf", "synthetic") / F.col("n_synthetic")).alias("pmf_syn")
    )
    w = weights(e, key, reps, seed, "bin", "grp", balance=("bin",) if balance else None, seed_by="bin")
    part = s.select("bin", "grp", key, "x", "pmf").join(w, ["bin", "grp", key]).withColumn("m", F.col("pmf") * F.col("w") / F.col("drawn"))
    part = part.groupBy("bin", "rep", "x").agg(_side("m", "natural").alias("a"), _side("m", "synthetic").alias("b"))
    grid = point.select("bin", "x", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    run = W.partitionBy("bin", "rep").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    reached = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(run)
    cdfs = grid.join(part, ["bin", "x", "rep"], "left").select("bin", "x", reached("a").alias("nat"), reached("b").alias("syn"))
    cdfs = cdfs.withColumn("delta", F.col("syn") - F.col("nat"))
    out = []
    for c in ("nat", "syn", "delta"):
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.025)).alias(f"{c}_lo"), F.percentile(c, F.lit(0.975)).alias(f"{c}_hi")]
    return cdfs.groupBy("bin", "x").agg(*out).join(point, ["bin", "x"])


def matrix_bins(entities: DataFrame, cells: DataFrame, key: str, reps: int, seed: int, least: int = 1) -> DataFrame:
    """L1 of both groups' mean matrices in each bin with a bootstrap interval: bin, n_natural, n_synthetic, l1, l1_lo, l1_hi.

    ``entities`` is (bin, grp, key), ``cells`` (key, x, y, n).  A genome without
    k-mers counts with a matrix of zeros.
    """
    ok = both_have(entities, least, "bin")
    e = entities.select("bin", "grp", key).join(ok, "bin")
    p = e.join(fcgr.normalised(cells.select(key, "x", "y", "n"), key), key)
    far = lambda value, n, s: F.coalesce(F.sum(F.when(F.col("grp") == s, F.col(value) / F.col(n))), F.lit(0.0))
    cell = p.groupBy("bin", "x", "y").agg(F.abs(far("p", "n_natural", "natural") - far("p", "n_synthetic", "synthetic")).alias("d"))
    point = ok.join(cell.groupBy("bin").agg(F.sum("d").alias("l1")), "bin")
    w = weights(e, key, reps, seed, "bin", "grp", seed_by="bin")
    r = p.select("bin", "grp", key, "x", "y", "p").join(w, ["bin", "grp", key]).withColumn("m", F.col("p") * F.col("w"))
    r = r.groupBy("bin", "rep", "x", "y").agg(F.abs(far("m", "drawn", "natural") - far("m", "drawn", "synthetic")).alias("d"))
    r = r.groupBy("bin", "rep").agg(F.sum("d").alias("d"))
    return point.join(r.groupBy("bin").agg(F.percentile("d", F.lit(0.025)).alias("l1_lo"), F.percentile("d", F.lit(0.975)).alias("l1_hi")), "bin")


def dataset_summary(distances: DataFrame, value: str, pair: str, reps: int, flips: int, seed: int, delta: float = 0.0) -> DataFrame:
    """Of one distance a pair: n, mean, median with its bootstrap interval, whether it tends to exceed ``delta`` (p, test) and the sign-flip p of the mean."""
    d = distances.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(pair, value)
    middle = stats.bootstrap(d, value, pair, reps, seed).groupBy("rep").agg(F.median(value).alias("m"))
    ci = middle.agg(F.percentile("m", F.lit(0.025)).alias("median_lo"), F.percentile("m", F.lit(0.975)).alias("median_hi"))
    flip = stats.sign_flips(d, value, pair, flips, seed).select(F.col("p").alias("p_signflip"))
    return stats.location_p(d, value, delta).crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(flip))  # one row each
