"""Absent, shared and novel k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmers, superkmers


def presence(seqs: DataFrame, k: int, pair: str = "pair_id", side: str = "which", canonical: bool = True) -> DataFrame:
    """(pair, kmer, in_orig, in_syn): one grouping gives intersection and both differences."""
    km = kmers.code_counts(seqs, k, pair, side, canonical=canonical)
    found = km.groupBy(pair, "code").agg(F.max(F.col(side) == "orig").alias("in_orig"), F.max(F.col(side) == "syn").alias("in_syn"))
    return found.select(pair, kmers.kmer_of(F.col("code"), k).alias("kmer"), "in_orig", "in_syn")


def pair_metrics(present: DataFrame, pair: str = "pair_id") -> DataFrame:
    return metrics_by(present, pair)


def metrics_by(present: DataFrame, *by: str) -> DataFrame:
    o, s = F.col("in_orig"), F.col("in_syn")
    return _rates(present.groupBy(*by).agg(
        F.count_if(o).alias("orig_unique"), F.count_if(s).alias("syn_unique"), F.count_if(o & s).alias("shared_unique"), F.count_if(o & ~s).alias("missing_in_syn"), F.count_if(s & ~o).alias("novel_in_syn")
    ))


def _rates(m: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return m.select(
        "*",
        share(F.col("shared_unique"), F.col("orig_unique") + F.col("syn_unique") - F.col("shared_unique")).alias("jaccard"),
        share(F.col("missing_in_syn"), F.col("orig_unique")).alias("missing_rate"),
        share(F.col("novel_in_syn"), F.col("syn_unique")).alias("novel_rate"),
    )


def joint_metrics(joint: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The same from a pair's joint spectrum, without a row for each k-mer."""
    o, s, n = F.col("orig") > 0, F.col("syn") > 0, F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return _rates(joint.groupBy(pair).agg(
        total(o).alias("orig_unique"), total(s).alias("syn_unique"), total(o & s).alias("shared_unique"), total(o & ~s).alias("missing_in_syn"), total(s & ~o).alias("novel_in_syn")
    ))


STATUSES = ("ok", "missing_fasta", "empty_kmc_db")  # fixed values


def pair_rows(seqs: DataFrame, k: int, pair: str = "pair_id", side: str = "which", seq: str = "seq") -> DataFrame:
    """The result row of every pair with k and its status: a side without a row is missing, one without k-mers is empty; such rows are zero."""
    sides = seqs.groupBy(pair).agg(F.count_if(F.col(side) == "orig").alias("_o"), F.count_if(F.col(side) == "syn").alias("_s"))
    j = sides.join(joint_metrics(superkmers.joint_spectrum(seqs, k, pair, side, seq, canonical=True), pair), pair, "left")
    missing = (F.col("_o") == 0) | (F.col("_s") == 0)
    empty = (F.coalesce("orig_unique", F.lit(0)) == 0) | (F.coalesce("syn_unique", F.lit(0)) == 0)
    values = [c for c in j.columns if c not in (pair, "_o", "_s")]
    shown = lambda c: F.when(missing | empty | F.col(c).isNull(), F.lit(0)).otherwise(F.col(c)).alias(c)
    status = F.when(missing, STATUSES[1]).when(empty, STATUSES[2]).otherwise(STATUSES[0])
    return j.select(pair, F.lit(k).alias("k"), *map(shown, values), status.alias("status"))


def fractions(seqs: DataFrame, ks: list[int], *by: str, canonical: bool = True, lettered: kmers.Lettered | None = None) -> DataFrame:
    """Per entity and k: distinct k-mers, the space of 4 ** k, and how much of it is unused; zero-hit entities included."""
    out = None
    for k in sorted(set(ks)):
        seen = superkmers.spectra(seqs, k, *by, canonical=canonical, lettered=lettered).groupBy(*by).agg(F.sum("n_x").alias("_n"))
        one = seqs.select(*by).distinct().join(seen, [*by], "left").select(*by, F.lit(k).alias("k"), F.coalesce("_n", F.lit(0)).alias("observed_distinct_kmers"))
        out = one if out is None else out.unionByName(one)
    return with_space(out)


def with_space(out: DataFrame) -> DataFrame:
    """Of (k, observed_distinct_kmers): the space of 4 ** k and how much of it is unused."""
    space = F.pow(F.lit(4.0), "k").cast("long")
    return out.select("*", space.alias("kmer_space"), (space - F.col("observed_distinct_kmers")).alias("nullomer_count"), ((space - F.col("observed_distinct_kmers")) / space).alias("nullomer_fraction"))


def absent(present: DataFrame, k: int) -> DataFrame:
    """The k-mers that no sequence has."""
    digit = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.shiftright("id", 2 * i), F.lit(4)).cast("int") + 1, F.lit(1))
    every = present.sparkSession.range(4**k).select(F.concat(*(digit(i) for i in reversed(range(k)))).alias("kmer"))
    return every.join(present.select("kmer").distinct(), "kmer", "left_anti")
