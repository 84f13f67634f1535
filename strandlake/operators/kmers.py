"""k-mer counting, abundance spectra and their distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.shared import settled

#: The number of each base letter; 4 stands for any other.
LETTERS = np.full(256, 4, dtype=np.uint8)
LETTERS[list(b"ACGT")] = range(4)


def letters(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base numbers of a column of sequences, one after another, and where each begins; null counts as empty."""
    text = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    text = text.cast(pa.large_binary()).fill_null(b"")
    first = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[first[0] : first[-1]]
    return LETTERS[data], first - first[0]


#: What makes sequences of a column of texts; steps on letters can do it themselves, a few rows at a time, so that no second worker holds a batch.
Lettered = Callable[[pa.Array], pa.Array]


def few(batches: Iterator[pa.RecordBatch], seq: str, lettered: Lettered | None = None, most: int = 1 << 20, sized: Lettered = pc.binary_length) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``most`` bytes of a column (or of what ``sized`` says), or one row; ``lettered`` makes sequences of that column."""
    for batch in batches:
        size = np.cumsum(np.maximum(pc.fill_null(sized(batch.column(seq)), 0).to_numpy().astype(np.int64), 0))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, "right")))
            own = batch.slice(row, to - row)
            yield own.set_column(own.schema.get_field_index(seq), seq, lettered(own.column(seq))) if lettered else own
            row = to


#: Letters that a task has as numbers at a time; the arrays of a step take some 100 bytes for each.
PIECE_LETTERS = 1 << 19


def pieces(column: pa.ChunkedArray | pa.Array, overlap: int, most: int = PIECE_LETTERS) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """A column of sequences in pieces of about ``most`` letters: (row, start, own, base numbers, where each sequence begins).

    A piece has whole rows from ``row`` on, or is cut out of one longer row from
    its letter ``start`` on, with ``overlap`` letters of the next piece, so that
    windows of one letter more are in just one piece.  Windows that are shorter
    have to begin within the first ``own`` letters.
    """
    text = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    text = text.cast(pa.large_binary()).fill_null(b"")
    first = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(text):
        if first[row + 1] - first[row] > most:
            begin, stop = int(first[row]), int(first[row + 1])
            for at in range(begin, max(begin + 1, stop - overlap), most):
                end = min(at + most + overlap, stop)
                yield row, at - begin, end - at if end == stop else most, LETTERS[data[at:end]], np.array([0, end - at])
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(first, first[row] + most, "right")) - 1)
        yield row, 0, int(first[to] - first[row]), LETTERS[data[first[row] : first[to]]], first[row : to + 1] - first[row]
        row = to


def codes(base: np.ndarray, first: np.ndarray, k: int, canonical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a base: the number of each k-mer of A, C, G and T, and the row in which it is."""
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = (base & 3).astype(np.int64)
    for j in range(k):
        forward = forward << 2 | low[j : j + n]
        if canonical:
            back |= (3 - low[j : j + n]) << 2 * j
    other = np.r_[0, np.cumsum(base == 4)]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    good = (other[k:] == other[:-k]) & (np.arange(n) + k <= first[row + 1])
    return (np.minimum(forward, back) if canonical else forward)[good], row[good]


def code_counts(seqs: DataFrame, k: int | str, *by: str, seq: str = "seq", canonical: bool = False, lettered: Lettered | None = None) -> DataFrame:
    """(by, code, n): k-mers (k of 31 at most) as numbers, first counted within a piece of the sequences, so that only numbers are shuffled.

    ``k`` may be the name of a ``by`` column with each sequence's own k; ``lettered`` makes sequences of the texts in ``seq``.
    """
    if k not in by if isinstance(k, str) else not 1 <= k <= 31:
        raise ValueError("k must be within 1..31 or name a column to group by")
    if by:
        keyed = seqs.select(*by, F.col(seq).alias("_s"))
    else:
        keyed = seqs.select(F.lit(0).alias("_one"), F.col(seq).alias("_s"))
    keys = keyed.columns[:-1]

    def own_k(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
        for batch in batches:
            if isinstance(k, int):
                yield batch, k
                continue
            own = batch.column(k)
            for one in own.unique().drop_null().to_pylist():
                yield batch.filter(pc.equal(own, one)), one

    def group_ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """A row of each group of equal keys, and the group of each row."""
        ids = np.zeros(rows.num_rows, np.int64)
        for c in keys:
            own = rows.column(c).dictionary_encode(null_encoding="encode")
            _, ids = np.unique(ids * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)
        return np.unique(ids, return_index=True)[1], ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, size in own_k(few(batches, "_s", lettered)):
            for at, _, _, base, first in pieces(batch.column("_s"), size - 1):
                head, group = group_ids(batch.slice(at, len(first) - 1))
                code, row = codes(base, first, size, canonical)
                group = group[row]
                if 2 * size + len(head).bit_length() <= 63:  # both in one number
                    code, n = np.unique(group << 2 * size | code, return_counts=True)
                    code, group = code & (1 << 2 * size) - 1, code >> 2 * size
                else:
                    order = np.lexsort((code, group))
                    code, group = code[order], group[order]
                    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])][: len(code)])
                    n = np.diff(np.r_[new, len(code)])
                    code, group = code[new], group[new]
                yield of_keys(batch, at + head[group], code, n)

    def of_keys(batch: pa.RecordBatch, row: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=[*keys, "code", "n"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1]), "code long, n long"])
    return keyed.mapInArrow(count, schema).groupBy(*by, "code").agg(F.sum("n").alias("n"))


def kmer_of(code: Column, k: int) -> Column:
    """The letters of a k-mer's number."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def counts(seqs: DataFrame, k: int, *by: str, seq: str = "seq", canonical: bool = False, lettered: Lettered | None = None) -> DataFrame:
    return code_counts(seqs, k, *by, seq=seq, canonical=canonical, lettered=lettered).select(*by, kmer_of(F.col("code"), k).alias("kmer"), "n")


def spectrum(kmer_counts: DataFrame, *by: str) -> DataFrame:
    """How many k-mers occur x times: (by, x, n_x)."""
    return kmer_counts.groupBy(*by, F.col("n").alias("x")).agg(F.count("*").alias("n_x"))


def pmf(spec: DataFrame, k: int) -> DataFrame:
    """n_x over 4 ** k; unseen k-mers are left out, so the sum is below one."""
    return spec.withColumn("pmf", F.col("n_x") / F.lit(float(4**k)))


def cdf(spec: DataFrame, *by: str) -> DataFrame:
    part = [F.col(c) for c in by] or [F.lit(1)]
    return spec.withColumn("cdf", F.sum("pmf").over(W.partitionBy(*part).orderBy("x").rowsBetween(W.unboundedPreceding, 0)))


def paired_support(spec: DataFrame, pair: str = "pair_id", side: str = "which") -> DataFrame:
    """Both sides' pmf and cdf on the union of their abundances: (pair, x, p, q, cp, cq)."""
    both = spec.groupBy(pair, "x").agg(
        F.coalesce(F.sum(F.when(F.col(side) == "orig", F.col("pmf"))), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.when(F.col(side) == "syn", F.col("pmf"))), F.lit(0.0)).alias("q")
    )
    run = W.partitionBy(pair).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return both.select("*", F.sum("p").over(run).alias("cp"), F.sum("q").over(run).alias("cq"))


def distances(support: DataFrame, pair: str = "pair_id", eps: float = 1e-12) -> DataFrame:
    """ks_stat, jsd_bits and emd_l1cdf per pair."""
    every = W.partitionBy(pair)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(eps), F.col(c)))
    s = support.select("*", (clip("p") / F.sum(clip("p")).over(every)).alias("_a"), (clip("q") / F.sum(clip("q")).over(every)).alias("_b"))
    m = (F.col("_a") + F.col("_b")) / 2
    kl = lambda c: F.sum(F.col(c) * F.log2(F.col(c) / m))
    gap = F.abs(F.col("cp") - F.col("cq"))
    return s.groupBy(pair).agg(F.max(gap).alias("ks_stat"), ((kl("_a") + kl("_b")) / 2).alias("jsd_bits"), F.sum(gap).alias("emd_l1cdf"))


def pair_metrics(seqs: DataFrame, k: int, pair: str = "pair_id", side: str = "which", seq: str = "seq") -> DataFrame:
    """The result row of each pair: distances and effective lengths."""
    from . import superkmers  # it builds on this module

    spec = superkmers.both_spectra(superkmers.joint_spectrum(seqs, k, pair, side, seq), k, pair)
    lengths = seqs.groupBy(pair).agg(*(F.sum(F.when(F.col(side) == s, dna.effective_length(seq))).alias(f"L_{s}_ACGT") for s in ("orig", "syn")))
    return distances(paired_support(spec, pair, side), pair).join(lengths, pair).withColumn("k_used", F.lit(k))


def own_k(seqs: DataFrame, pair: str = "pair_id", side: str = "which", seq: str = "seq") -> DataFrame:
    """Effective lengths and k of each pair: the k that suits its shorter side, and ``status``, missing_fasta if a side has no row."""
    lengths = seqs.groupBy(pair).agg(*(F.sum(F.when(F.col(side) == s, dna.effective_length(seq))).alias(f"L_{s}_ACGT") for s in ("orig", "syn")))
    both = F.col("L_orig_ACGT").isNotNull() & F.col("L_syn_ACGT").isNotNull()
    k = F.when(both, dna.auto_k(F.least("L_orig_ACGT", "L_syn_ACGT"))).alias("k_used")
    return lengths.select(pair, k, "L_orig_ACGT", "L_syn_ACGT", F.when(both, "ok").otherwise("missing_fasta").alias("status"))


def pair_metrics_own_k(seqs: DataFrame, pair: str = "pair_id", side: str = "which", seq: str = "seq") -> DataFrame:
    """As ``pair_metrics``, each pair with its own k; a pair without both sides keeps its row with a status and null distances."""
    rows = own_k(seqs, pair, side, seq)
    keyed = seqs.select(pair, side, F.col(seq).alias("seq")).join(rows.where(F.col("status") == "ok").select(pair, "k_used"), pair)
    spec = spectrum(code_counts(keyed, "k_used", pair, side, "k_used"), pair, side, "k_used")
    spec = spec.withColumn("pmf", F.col("n_x") / F.pow(F.lit(4.0), F.col("k_used")))
    return rows.join(distances(paired_support(spec, pair, side), pair), pair, "left")


#: Pmfs and cdfs of both sides and the cdf difference.
MEASURES = ("p", "q", "cp", "cq", "d")


def support_means(support: DataFrame) -> DataFrame:
    """The means of ``support_stats`` alone: running sums over the abundances of what the pairs' values grow by, so that no pair meets every abundance."""
    support = settled(support)
    pairs = support.agg(F.count_distinct("pair_id").alias("_pairs"))
    before = W.partitionBy("pair_id").orderBy("x")
    grown = support.select("x", "p", "q", *((F.col(c) - F.lag(c, 1, 0.0).over(before)).alias(c) for c in ("cp", "cq")))
    run = W.partitionBy(F.lit(1)).orderBy("x").rowsBetween(W.unboundedPreceding, 0)  # one row an abundance
    at = grown.groupBy("x").agg(*(F.sum(c).alias(c) for c in ("p", "q", "cp", "cq"))).select("x", "p", "q", *(F.sum(c).over(run).alias(c) for c in ("cp", "cq")))
    means = at.withColumn("d", F.col("cq") - F.col("cp")).crossJoin(F.broadcast(pairs))
    return means.select("x", *((F.col(c) / F.col("_pairs")).alias(f"{c}_mean") for c in MEASURES))


def support_stats(support: DataFrame) -> DataFrame:
    """Over all pairs, for each abundance: mean and central 95 % of both pmfs, cdfs and the cdf difference.

    Pairs without an abundance count with a pmf of zero and the cdf that they have reached.  Each value's pairs
    are counted at the abundances where their number changes; the rows are
    values by abundances (values are counts over 4 ** k), however many pairs there are.
    """
    support = settled(support)
    spark = support.sparkSession
    # one row an abundance; a pair of sequences has at most the square root of twice their letters
    xs = support.select("x").distinct().select("x", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("x")) - 1).alias("_i"))
    xs = settled(xs)
    n_x, pairs = xs.count(), support.agg(F.count_distinct("pair_id")).first()[0]
    before = W.partitionBy("pair_id").orderBy("_i")
    s = support.withColumn("d", F.col("cq") - F.col("cp")).join(F.broadcast(xs), "x")
    s = s.select("_i", *MEASURES, *(F.lag(c, 1, 0.0).over(before).alias(f"_{c}") for c in MEASURES[2:]))
    change = lambda c, i, v, n: F.struct(F.lit(c).alias("c"), i.alias("i"), v.alias("v"), F.lit(n).cast("long").alias("n"))
    i, zero = F.col("_i"), F.lit(0.0)
    changes = [change(c, i, F.col(v), n) for c in MEASURES[2:] for v, n in ((c, 1), (f"_{c}", -1))]
    changes += [change(c, at, v, n) for c in MEASURES[:2] for at, v, n in ((i, F.col(c), 1), (i, zero, -1), (i + 1, F.col(c), -1), (i + 1, zero, 1))]
    start = spark.createDataFrame([(c, 0, 0.0, pairs) for c in MEASURES], "c string, i int, v double, n long")
    changed = s.select(F.inline(F.array(*changes))).unionByName(start).groupBy("c", "v", "i").agg(F.sum("n").alias("n")).where("n <> 0")
    w = W.partitionBy("c", "v").orderBy("i")
    held = changed.select("c", "v", "i", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"), F.lead("i", 1, n_x).over(w).alias("_to")).where((F.col("n") > 0) & (F.col("_to") > F.col("i")))
    dist = held.select("c", "v", "n", F.explode(F.sequence("i", F.col("_to") - 1)).alias("_i"))
    dist = dist.withColumn("_up", F.sum("n").over(W.partitionBy("c", "_i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    out = [(F.sum(F.when(F.col("c") == c, F.col("v") * F.col("n"))) / pairs).alias(f"{c}_mean") for c in MEASURES]
    for end, q in (("lo", 0.025), ("hi", 0.975)):
        place = (pairs - 1) * q
        below, above = math.floor(place), math.ceil(place)
        value = lambda c, r: F.max(F.when((F.col("c") == c) & (F.col("_up") > r) & (F.col("_up") - F.col("n") <= r), F.col("v")))
        for c in MEASURES:
            lo, hi = value(c, below), value(c, above)
            out.append(F.when(lo == hi, lo).otherwise((above - place) * lo + (place - below) * hi).alias(f"{c}_{end}"))
    names = [f"{c}_{e}" for c in MEASURES for e in ("mean", "lo", "hi")]
    return dist.groupBy("_i").agg(*out).join(F.broadcast(xs), "_i").select("x", *names)


def effect_sizes(stats: DataFrame, x_max: int = 500) -> DataFrame:
    """Largest absolute mean cdf difference, the first abundance with it, and the last difference."""
    s = stats.where(F.col("x") <= x_max)
    return s.agg(
        F.max(F.abs("d_mean")).alias("max_abs_delta"), F.max_by("x", F.struct(F.abs("d_mean"), -F.col("x"))).alias("x_at_max"), F.max_by("d_mean", "x").alias("last_delta")
    )


def zone_masses(spec: DataFrame, rare: int, high: int, x_max: int, *by: str) -> DataFrame:
    """pmf mass of rare (1..rare), middle and high abundances."""
    mass = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("x").between(lo, hi), F.col("pmf"))), F.lit(0.0))
    return spec.groupBy(*by).agg(mass(1, rare).alias("rare"), mass(rare + 1, high).alias("mid"), mass(high + 1, x_max).alias("high"))


def dense_histogram(spec: DataFrame, x_max: int, *by: str) -> DataFrame:
    """pmf for every x in 1..x_max, zero where there is none."""
    grid = spec.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(x_max).cast("long"))).alias("x"))
    return grid.join(spec.select(*by, "x", "pmf"), [*by, "x"], "left").withColumn("pmf", F.coalesce("pmf", F.lit(0.0)))


def smoothed(dense: DataFrame, window: int, x_max: int, *by: str) -> DataFrame:
    """Centred moving average over an odd window, the edges reflected."""
    h = window // 2
    x = F.col("x")
    left = dense.where(x.between(2, h + 1)).withColumn("x", 2 - x)
    right = dense.where(x.between(x_max - h, x_max - 1)).withColumn("x", 2 * x_max - x)
    part = [F.col(c) for c in by] or [F.lit(1)]
    frame = W.partitionBy(*part).orderBy("x").rowsBetween(-h, h)
    return dense.unionByName(left).unionByName(right).withColumn("smooth", F.avg("pmf").over(frame)).where(x.between(1, x_max))


def quantiles(spec_cdf: DataFrame, *by: str, points: int = 99) -> DataFrame:
    """x at the probabilities 1/100..99/100 by linear interpolation of the cdf, clamped at its ends."""
    part = [F.col(c) for c in by] or [F.lit(1)]
    w = W.partitionBy(*part).orderBy("x")
    all_ = W.partitionBy(*part)
    s = spec_cdf.select(*by, "x", "cdf", F.lead("x").over(w).alias("x1"), F.lead("cdf").over(w).alias("c1"), F.min("cdf").over(all_).alias("c_lo"), F.max("cdf").over(all_).alias("c_hi"))
    s = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("i")).withColumn("prob", F.col("i") / 100.0)
    inside = (F.col("prob") >= F.col("cdf")) & (F.col("prob") < F.col("c1"))
    below = (F.col("prob") < F.col("c_lo")) & (F.col("cdf") == F.col("c_lo"))
    above = (F.col("prob") >= F.col("c_hi")) & F.col("c1").isNull()
    at = F.when(inside, F.col("x") + (F.col("prob") - F.col("cdf")) / (F.col("c1") - F.col("cdf")) * (F.col("x1") - F.col("x"))).otherwise(F.col("x").cast("double"))
    return s.where(inside | below | above).groupBy(*by, "prob").agg(F.min(at).alias("x_q"))


def bin_summary(delta: DataFrame, early: int, *by: str) -> DataFrame:
    """Of (by, x, delta): last difference, early mean and share above zero, places of the extremes, and the crossing flag."""
    d, x = F.col("delta"), F.col("x")
    is_early = x <= early
    out = delta.groupBy(*by).agg(
        F.max_by("delta", "x").alias("delta_coverage"), F.avg(F.when(is_early, d)).alias("early_mean"), F.avg(F.when(is_early, (d > 0).cast("double"))).alias("early_positive"),
        F.max_by("x", F.struct(d, -x)).alias("x_max"), F.min_by("x", F.struct(d, x)).alias("x_min"), F.avg(d).alias("mean_delta"),
    )
    return out.withColumn("crosses", (F.col("early_mean") > 0) & (F.col("delta_coverage") < 0))


def verdict(share: Column) -> Column:
    """How general a sign is over bins."""
    return F.when(share >= 0.7, "mostly positive").when(share <= 0.3, "mostly negative").otherwise("mixed")


def general_pattern(summaries: DataFrame, *by: str) -> DataFrame:
    """Signs of the bins' summaries (of ``bin_summary``) counted over all bins, and a verdict for coverage and for the early part.

    Only finite values count; a verdict without any is null.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cov, early = F.col("delta_coverage"), F.col("early_mean")
    g = summaries.groupBy(*by).agg(
        F.count("*").alias("n_bins"), F.count_if(finite("delta_coverage")).alias("n_coverage"), F.count_if(finite("delta_coverage") & (cov < 0)).alias("coverage_negative"),
        F.count_if(finite("delta_coverage") & (cov > 0)).alias("coverage_positive"), F.count_if(finite("early_mean")).alias("n_early"), F.count_if(finite("early_mean") & (early > 0)).alias("early_positive"),
        F.count_if(finite("early_mean") & (early < 0)).alias("early_negative"), F.count_if("crosses").alias("n_split"),
    )
    told = lambda k, n, most, least: F.when(F.col(n) > 0, F.when(F.col(k) / F.col(n) >= 0.7, most).when(F.col(k) / F.col(n) <= 0.3, least).otherwise("mixed"))
    return g.select("*", told("coverage_negative", "n_coverage", "lower", "higher").alias("coverage"), told("early_positive", "n_early", "positive", "negative").alias("early"))
