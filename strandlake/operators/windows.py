"""Sampling of windows from contigs."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna, stats
from ..functions.shared import settled


def allocation(contigs: DataFrame, n_windows: int) -> DataFrame:
    """Windows for each contig (name, length) by largest remainders, ties by name; null if no contig has a length.

    No sort of all contigs: at most ``n_windows`` of them get one of the rest.
    """
    contigs = settled(contigs.select("name", "length"))  # two narrow columns, read four times
    total = F.sum("length").alias("_total")
    a = contigs.crossJoin(F.broadcast(contigs.agg(total))).withColumn("_share", F.try_divide(F.lit(float(n_windows)) * F.col("length"), F.col("_total")))
    a = a.withColumn("_base", F.floor("_share")).withColumn("_left", F.col("_share") - F.col("_base"))
    given = a.agg(F.sum("_base")).first()[0]
    rest = 0 if given is None else max(0, n_windows - int(given))
    more = a.orderBy(F.desc("_left"), "name").limit(rest).select(F.col("name").alias("_name"))
    got = a.join(F.broadcast(more), F.col("name") == F.col("_name"), "left")
    return got.select("name", "length", (F.col("_base") + F.when(F.col("_name").isNotNull(), 1).otherwise(0)).cast("long").alias("n_windows"))


def candidates(contigs: DataFrame, length: int, tries: int, seed: int, max_n_ratio: float, seq: str = "seq") -> DataFrame:
    """Possible windows at places fixed by the seed, N-rich ones left out: (name, try, start, window)."""
    c = contigs.where(F.length(seq) >= length).select("name", seq, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    at = (stats.draw(seed, F.col("name"), F.col("try")) % (F.length(seq) - length + 1)).cast("int")
    w = c.select("name", "try", at.alias("start"), F.substr(seq, at + 1, F.lit(length)).alias("window"))
    return w.where(dna.n_ratio("window") <= max_n_ratio)


def spaced(possible: DataFrame, length: int, min_gap: int) -> DataFrame:
    """Greedily keeps candidates, in the order of their tries, that stay min_gap away from those already kept."""
    clash = lambda kept, s: F.exists(kept, lambda k: dna.overlaps_within(s, s + length, k, k + length, min_gap))
    g = possible.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("try", "start"))).alias("c"))
    fold = F.aggregate("c", F.array().cast("array<int>"), lambda kept, x: F.when(clash(kept, x["start"]), kept).otherwise(F.concat(kept, F.array(x["start"]))))
    return g.select("name", F.explode(fold).alias("start"))


def filled(contigs: DataFrame, length: int, min_gap: int, max_n_ratio: float, seed: int, seq: str = "seq", tries: int = 20_000, relaxed_tries: int = 50_000) -> DataFrame:
    """As many windows of each contig (name, seq, n_windows) as it was given: name, start, length, relaxed, window.

    Places are drawn one after another from the seed and the contig's name; one
    that is rich in N or nearer than ``min_gap`` to a window already taken is
    rejected.  After ``tries`` the rest is drawn without the test for N
    (``relaxed``), up to ``relaxed_tries``; a contig without room gets fewer.  A
    contig shorter than a window is one window.  Each contig is a row of its
    own, so nothing is shuffled.
    """

    def sample(batches):
        for batch in batches:
            names, starts, sizes, loose, cut = [], [], [], [], []
            for name, text, need in zip(batch["name"].to_pylist(), batch["_s"].to_pylist(), batch["n_windows"].to_pylist(), strict=True):
                size = min(length, len(text))
                if not size or not need:
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                n_before = np.r_[0, np.cumsum((letters == ord("N")) | (letters == ord("n")))]
                taken: list[int] = []  # sorted, at least min_gap apart: only the neighbours can clash
                for relax, limit in ((False, tries), (True, relaxed_tries)):
                    got = len(taken)
                    for start in rng.integers(0, len(text) - size + 1, limit if got < need else 0).tolist():
                        if not relax and n_before[start + size] - n_before[start] > max_n_ratio * size:
                            continue
                        at = bisect.bisect(taken, start)
                        if (at and start <= taken[at - 1] + size - 1 + min_gap) or (at < len(taken) and taken[at] <= start + size - 1 + min_gap):
                            continue
                        taken.insert(at, start)
                        names.append(name), starts.append(start), sizes.append(size), loose.append(relax), cut.append(text[start : start + size])
                        if len(taken) == need:
                            break
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(loose, pa.bool_()), pa.array(cut, pa.string())], names=["name", "start", "length", "relaxed", "window"])

    rows = contigs.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.col(seq), F.lit("")).alias("_s"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))
    return rows.where("n_windows > 0").mapInArrow(sample, "name string, start long, length long, relaxed boolean, window string")


def window_header(name: str = "name", start: str = "start", length: str = "length"):
    """The FASTA header of a window: the contig and its place, counted from one, both ends included."""
    return F.concat(F.col(name), F.lit(":"), (F.col(start) + 1).cast("string"), F.lit("-"), (F.col(start) + F.col(length)).cast("string"))
