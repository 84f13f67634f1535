"""Transcription-factor motif hits: scanning, counting and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import kmers


def background(seqs: DataFrame, seq: str = "seq", *by: str) -> DataFrame:
    """Share of each base; 0.25 where there is none."""
    n = {b: F.sum(F.length(seq) - F.length(F.translate(F.col(seq), b, ""))) for b in "ACGT"}
    total = n["A"] + n["C"] + n["G"] + n["T"]
    return seqs.groupBy(*by).agg(*(F.when(total > 0, n[b] / total).otherwise(F.lit(0.25)).alias(b) for b in "ACGT"))


#: A score is rounded to a whole number of these parts before its p-value is looked up.
GRAIN = 1000
#: Motifs are a reference table that every task holds; a larger one has to be scanned in parts.
MOST_MOTIFS = 100_000
#: What gives batches with sequences in a column, a few rows at a time; it may make them there of something smaller, so that no worker gets a batch of whole sequences.
Made = Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]


def score_tail(scores: np.ndarray, base: np.ndarray) -> tuple[int, np.ndarray]:
    """The least score of a motif in grains, and for each score from there the chance of it or more in random letters."""
    grains = np.rint(np.asarray(scores) * GRAIN).astype(np.int64)
    low = grains.min(axis=1)
    chance = np.ones(1)
    for row, lo in zip(grains, low, strict=True):
        out = np.zeros(len(chance) + int(row.max() - lo))
        for g, b in zip(row - lo, base, strict=True):
            out[g : g + len(chance)] += b * chance
        chance = out
    return int(low.sum()), np.minimum(1.0, np.cumsum(chance[::-1])[::-1])


def scan(seqs: DataFrame, motifs: DataFrame, *keep: str, seq: str = "seq", site_p: float | None = None, base: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), made: Made = kmers.few) -> DataFrame:
    """Hits of motifs (motif_id, motif_alt_id, w, scores: w rows of A, C, G, T log-odds, threshold) on both strands, with p-values.

    A window is a hit if its score is at least the threshold and, if ``site_p``
    is given, its p-value below that.  P-values are exact for scores in grains
    under independent letters with the shares ``base``.  Windows with other
    letters don't count.  ``made`` makes the sequences, if ``seq`` isn't them.
    """
    table = motifs.limit(MOST_MOTIFS + 1).collect()
    if len(table) > MOST_MOTIFS:
        raise ValueError("too many motifs for one scan")
    known = [(m.motif_id, m.motif_alt_id, m.threshold, np.array(m.scores, dtype=float)) for m in table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = [score_tail(x, np.array(base)) for *_, x in known]
        for batch in made(batches, "_s"):
            yield from _scanned(batch, keep, known, tails, site_p)

    return seqs.select(*keep, F.col(seq).alias("_s")).mapInArrow(run, _schema(seqs, keep))


def _schema(seqs: DataFrame, keep: tuple[str, ...]) -> str:
    types = ("string", "string", "string", "long", "long", "double", "double")
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.select(*keep).schema), *(f"`{c}` {t}" for c, t in zip(HITS, types, strict=True))])


def _scanned(batch: pa.RecordBatch, keep: tuple[str, ...], known: list[tuple], tails: list[tuple[int, np.ndarray]], site_p: float | None) -> Iterator[pa.RecordBatch]:
    """Hits of motifs (id, other name, threshold, scores) in the sequences of a batch."""
    widest = max((len(x) for *_, x in known), default=1)
    for piece in kmers.pieces(batch.column("_s"), widest - 1):
        yield from _scanned_piece(batch, piece, keep, known, tails, site_p)


def _scanned_piece(batch: pa.RecordBatch, piece: tuple, keep: tuple[str, ...], known: list[tuple], tails: list[tuple[int, np.ndarray]], site_p: float | None) -> Iterator[pa.RecordBatch]:
    at, begin, own_letters, letter, first = piece
    other = np.r_[0, np.cumsum(letter == 4)]
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for (name, alt, threshold, x), (least, tail) in zip(known, tails, strict=True):
        n, w = min(len(letter) - len(x) + 1, own_letters), len(x)
        if n <= 0:
            continue
        good = (other[w : w + n] == other[:n]) & (np.arange(n) + w <= first[row_of[:n] + 1])
        for strand, y in (("+", x), ("-", x[::-1, ::-1])):
            y = np.c_[y, np.zeros(w)]
            score = sum(y[j][letter[j : j + n]] for j in range(w))
            hit = np.flatnonzero(good & (score >= threshold))
            p = tail[np.clip(np.rint(score[hit] * GRAIN).astype(np.int64) - least, 0, len(tail) - 1)]
            if site_p is not None:
                hit, p = hit[p < site_p], p[p < site_p]
            start = begin + hit - first[row_of[hit]]
            own = [batch.column(c).take(pa.array(at + row_of[hit])) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array([name] * len(hit), pa.string()), pa.array([alt] * len(hit), pa.string()), pa.array([strand] * len(hit), pa.string()), pa.array(start, pa.int64()), pa.array(start + w, pa.int64()), pa.array(score[hit]), pa.array(p)], names=[*keep, *HITS])


HITS = ("motif_id", "motif_alt_id", "strand", "start", "end", "score", "p_value")


def scan_own(seqs: DataFrame, motifs: DataFrame, *keep: str, seq: str = "seq", base: str = "base", site_p: float = 1e-4, pseudocount: float = 0.1, digits: int = 2, made: Made = kmers.few) -> DataFrame:
    """Hits below ``site_p`` of motifs (motif_id, motif_alt_id, matrix) against each sequence's own background.

    ``base`` names an array of the sequence's shares of A, C, G and T; they are
    rounded to ``digits``, and never below one unit there, so that scores and
    p-value tables of a background are made once in a task and kept for the
    sequences that share it.  Scores are log2 odds in grains, p-values exact
    for them.  ``made`` is as in ``scan``.
    """
    table = motifs.limit(MOST_MOTIFS + 1).collect()
    if len(table) > MOST_MOTIFS:
        raise ValueError("too many motifs for one scan")
    matrices = [(m.motif_id, m.motif_alt_id, np.array(m.matrix, dtype=float)) for m in table]
    unit = 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[float, ...], tuple[list, list]] = {}
        for batch in made(batches, "_s"):
            shares = np.array([b or [0.25] * 4 for b in batch.column("_b").to_pylist()], dtype=float).reshape(-1, 4)
            shares = np.maximum(np.rint(shares / unit), 1)
            shares /= shares.sum(axis=1, keepdims=True)
            for b in np.unique(shares, axis=0):
                key = tuple(b)
                if key not in known:
                    if len(known) >= 64:  # bounds a task's memory; the oldest goes
                        known.pop(next(iter(known)))
                    scores = [np.rint(np.log2((m + pseudocount * b) / (1 + pseudocount) / b) * GRAIN) / GRAIN for *_, m in matrices]
                    known[key] = ([(i, alt, -np.inf, x) for (i, alt, _), x in zip(matrices, scores, strict=True)], [score_tail(x, b) for x in scores])
                yield from _scanned(batch.filter(pa.array((shares == b).all(axis=1))), keep, *known[key], site_p)

    return seqs.select(*keep, F.col(seq).alias("_s"), F.col(base).cast("array<double>").alias("_b")).mapInArrow(run, _schema(seqs, keep))


def with_q(hits: DataFrame, *by: str) -> DataFrame:
    """Hits with q-values within each motif (and ``by``)."""
    return stats.bh(hits, "p_value", (*by, "motif_id"), "q_value")


def hit_counts(hits: DataFrame, pair: str = "pair_id", side: str = "which") -> DataFrame:
    """Hits of each motif (motif_key: its id and other name) on both sides over all pairs."""
    key = F.concat_ws("|", "motif_id", "motif_alt_id").alias("motif_key")
    return hits.groupBy(key).agg(F.count_if(F.col(side) == "orig").alias("hits_orig"), F.count_if(F.col(side) == "syn").alias("hits_syn"))


def surviving(hits: DataFrame, site_p: float = 1e-4, site_q: float = 1.0) -> DataFrame:
    """Hits strictly below both limits."""
    return hits.where((F.col("p_value") < site_p) & (F.col("q_value") < site_q))


def enrichment(counts: DataFrame, least_p: float = 1e-300) -> DataFrame:
    """(motif_key, hits_orig, hits_syn) -> totals over all motifs, log2 fold change, Fisher p and q; motifs without hits are dropped.

    A p below ``least_p`` counts as that; without it (zero) a p too small for a double is zero, and its negative logarithm infinite.
    """
    total = counts.agg(F.sum("hits_orig").alias("total_orig"), F.sum("hits_syn").alias("total_syn"))
    c = counts.crossJoin(F.broadcast(total)).where(F.col("hits_orig") + F.col("hits_syn") > 0)
    c = c.withColumn("log2fc", F.log2((F.col("hits_orig") + 0.5) / (F.col("hits_syn") + 0.5)))
    p = stats.fisher_two_sided("hits_orig", F.col("total_orig") - F.col("hits_orig"), "hits_syn", F.col("total_syn") - F.col("hits_syn"))
    c = c.withColumn("p", F.greatest(F.lit(least_p), p)).withColumn("neglog10_p", F.when(F.col("p") > 0, -F.log10("p")).otherwise(F.lit(float("inf"))))
    return stats.bh(c, "p", tie=("motif_key",), q="p_fdr")


def volcano(rows: DataFrame, p: float = 0.05, fold: float = 1.0) -> DataFrame:
    strong = (F.col("p") < p) & (F.abs("log2fc") > fold)
    return rows.withColumn("colour", F.when(strong & (F.col("log2fc") > 0), "red").when(strong, "blue").otherwise("grey"))


def top(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("p", "motif_key").limit(n)
