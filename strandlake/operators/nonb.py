"""Non-B DNA structures: callers, harmonised hits and their comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna, stats
from . import kmers

HITS = "class string, start long, end long, strand string, score double"


def quadruplex_counts(seqs: DataFrame, *keep: str, seq: str = "seq") -> DataFrame:
    """n_hits and bp_covered of the G-quadruplex pattern for each sequence."""
    hits = seqs.select(*keep, dna.g_quadruplexes(seq).alias("_h"))
    return hits.select(*keep, F.size("_h").cast("long").alias("n_hits"), F.length(F.array_join("_h", "")).cast("long").alias("bp_covered"))


def repeat_counts(seqs: DataFrame, unit: str, copies: int, *keep: str, seq: str = "seq") -> DataFrame:
    """n_hits and bp_covered of a short tandem repeat of one unit."""
    hits = seqs.select(*keep, F.regexp_extract_all(F.col(seq), F.lit(f"((?:{unit}){{{copies},}})"), 1).alias("_h"))
    return hits.select(*keep, F.size("_h").cast("long").alias("n_hits"), F.length(F.array_join("_h", "")).cast("long").alias("bp_covered"))


def g4hunter_regions(seq: str, window: int = 25, threshold: float = 1.2) -> list[tuple[int, int, float]]:
    """Merged windows whose mean run score is at least the threshold, cut to whole runs of G or C at their ends.

    A G in a run of n scores min(n, 4), a C the negative, anything else 0; a region scores its mean.
    """
    s = np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)
    if len(s) < window:
        return []
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    end = np.r_[begin[1:], len(s)]
    sign = (s == ord("G")).astype(np.int64) - (s == ord("C"))
    total = np.r_[0, np.cumsum(sign * np.minimum(np.repeat(end - begin, end - begin), 4))]
    good = np.flatnonzero(np.abs(total[window:] - total[:-window]) >= threshold * window)
    if not len(good):
        return []
    new = np.flatnonzero(np.r_[True, good[1:] > good[:-1] + window])
    first, last = good[new], good[np.r_[new[1:] - 1, len(good) - 1]] + window
    run = np.repeat(np.arange(len(begin)), end - begin)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        inside = np.flatnonzero(sign[a:b]) + a
        a, b = int(begin[run[inside[0]]]), int(end[run[inside[-1]]])
        out.append((a, b, float(total[b] - total[a]) / (b - a)))
    return out


#: Weights of dinucleotide steps towards Z-DNA.
Z_WEIGHTS = {"GC": 7.0, "CG": 7.0, "GT": 1.25, "AC": 1.25, "TG": 1.25, "CA": 1.25, "AT": 0.5, "TA": 0.5}


def _z_steps(seq: str, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The value of each step between two letters, and for penalised ones their place in their run, counted from 1 (else 0)."""
    c = kmers.LETTERS[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)].astype(np.int64)
    weight = np.zeros(25)
    for step, w in Z_WEIGHTS.items():
        weight["ACGT".index(step[0]) * 5 + "ACGT".index(step[1])] = w
    w = weight[c[:-1] * 5 + c[1:]]
    good = np.flatnonzero(w > 0)
    last = np.full(len(w), -1)
    last[good] = good
    place = np.arange(len(w)) - np.maximum.accumulate(last) if len(w) else last
    return np.where(place > 0, -penalty * place, w), place


def _z_limit(minimum: float, penalty: float) -> int:
    """Penalised steps in a row that end every stretch."""
    n = 1
    while penalty * n * (n + 1) / 2 <= minimum:
        n += 1
    return n


def zdna_breaks(seq: str, minimum: float = 50.0, penalty: float = 3.0) -> tuple[int, int] | None:
    """The first and the last place at which a search begins anew whatever is before it; None if there is no such place."""
    at = np.flatnonzero(_z_steps(seq, penalty)[1] >= _z_limit(minimum, penalty)) + 1 if len(seq) > 1 else ()
    return (int(at[0]), int(at[-1])) if len(at) else None


def zdna_regions(seq: str, minimum: float = 50.0, penalty: float = 3.0) -> list[tuple[int, int, float]]:
    """All maximal stretches whose summed weight is at least the minimum; other steps cost a penalty that grows with their run.

    A stretch ends at its best sum once the sum has fallen to zero or by more than the minimum; the search goes on behind that end.
    Only parts between breaks whose sum rises by the minimum somewhere are walked step by step.
    """
    if len(seq) < 2:
        return []
    value, place = _z_steps(seq, penalty)
    total = np.cumsum(value)
    risen = np.flatnonzero(total - np.minimum.accumulate(np.r_[0.0, total])[:-1] >= minimum)
    if not len(risen):
        return []
    edge = np.r_[0, np.flatnonzero(place == _z_limit(minimum, penalty)) + 1, len(value)]
    out = []
    for part in np.unique(np.searchsorted(edge, risen, side="right") - 1).tolist():
        begin = int(edge[part])
        out += [(a + begin, b + begin, s) for a, b, s in _z_walk(value[begin : edge[part + 1]].tolist(), minimum)]
    return out


def _z_walk(value: list[float], minimum: float) -> list[tuple[int, int, float]]:
    out, i, last = [], 0, len(value)
    while i < last:
        total, best, end, k = 0.0, 0.0, i, i
        while k < last:
            total += value[k]
            if total > best:
                best, end = total, k + 2
            if total <= 0 or best - total > minimum:
                break
            k += 1
        if best >= minimum:
            out.append((i, end, best))
            i = end - 1
        else:
            i = k + 1
    return out


def g4hunter_breaks(seq: str, window: int = 25, threshold: float = 1.2) -> tuple[int, int] | None:
    """The first and the last place that no region reaches or merges across, whatever is around ``seq``; None if there is none.

    Such a place is the beginning of a run of letters with no good window that begins within ``window`` letters before it.
    """
    s = np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    if len(begin) < 3 or len(s) < 2 * window:
        return None
    size = np.diff(np.r_[begin, len(s)])
    sign = (s == ord("G")).astype(np.int64) - (s == ord("C"))
    total = np.r_[0, np.cumsum(sign * np.minimum(np.repeat(size, size), 4))]
    good = np.r_[0, np.cumsum(np.abs(total[window:] - total[:-window]) >= threshold * window)]
    # the first and last run may go on outside
    at = begin[(begin - window >= begin[1]) & (begin + window - 1 <= begin[-1])]
    at = at[good[at] == good[at - window]]
    return (int(at[0]), int(at[-1])) if len(at) else None


def _bases(seq: str) -> np.ndarray:
    return kmers.LETTERS[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)].astype(np.int64)


def _seeds(c: np.ndarray, k: int, other: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the number of the k letters there, that of their reverse (complement), and whether all are bases."""
    n = max(0, len(c) - k + 1)
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        forward = forward << 2 | (c[j : j + n] & 3)
        back |= ((3 - (c[j : j + n] & 3)) if other == "complement" else (c[j : j + n] & 3)) << 2 * j
    bad = np.r_[0, np.cumsum(c == 4)]
    return forward, back, bad[k : k + n] == bad[:n]


def _partners(key: np.ndarray, at: np.ndarray, of: np.ndarray, where: np.ndarray, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, q) of ``at`` and ``where`` with equal numbers and near <= q - p <= far, a few million at once."""
    n = int(max(at.max(initial=0), where.max(initial=0))) + far + 2
    index, asked = np.sort(of * n + where), np.sort(key * n + at)  # ascending questions stay in the cache
    lo, hi = np.searchsorted(index, asked + near), np.searchsorted(index, asked + far, side="right")
    some = hi > lo
    lo, count, at = lo[some], (hi - lo)[some], (asked % n)[some]
    upto, begin = np.cumsum(count), 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + (1 << 22), side="right")))
        c = count[begin:end]
        place = np.repeat(lo[begin:end] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        yield np.repeat(at[begin:end], c), index[place] % n
        begin = end


def bounded_repeats(seq: str, most_arm: int = 300, own: range | None = None) -> list[tuple[str, int, int, int]]:
    """Direct repeats that begin, and inverted and mirror repeats whose inner pair has its left letter, in ``own`` (all of the sequence).

    Every repeat holds a pair of equal seeds: 10 letters and themselves for
    DR, 6 and their reverse complement for IR, 10 and their reverse for MR.
    The pairs within reach are looked up in a sorted index, and arms extended.
    """
    c, out = _bases(seq), []
    n = len(c)
    own = range(n) if own is None else own
    forward, _, known = _seeds(c, 10, "same")
    where = np.flatnonzero(known)
    at = where[(where >= own.start) & (where < own.stop)]
    for p, q in _partners(forward[at], at, forward[where], where, 10, most_arm + 10):
        first = (p == 0) | (c[p - 1] != c[q - 1]) | (c[p - 1] == 4)
        p, q = p[first], q[first]
        arm, shift = np.full(len(p), 10), q - p
        live = np.arange(len(p))
        while len(live):
            live = live[(arm[live] < np.minimum(shift[live], most_arm)) & (q[live] + arm[live] < n)]
            live = live[(c[p[live] + arm[live]] == c[q[live] + arm[live]]) & (c[p[live] + arm[live]] < 4)]
            arm[live] += 1
        good = shift - arm <= 10
        out += [("DR", a, b + r, r) for a, b, r in zip(p[good].tolist(), q[good].tolist(), arm[good].tolist(), strict=True)]
    for name, least, other in (("IR", 6, "complement"), ("MR", 10, "same")):
        forward, back, known = _seeds(c, least, other)
        where = np.flatnonzero(known)
        at = where[(where + least - 1 >= own.start) & (where + least - 1 < own.stop)]
        pair = (lambda i, j: (c[i] + c[j] == 3) & (c[i] < 4) & (c[j] < 4)) if name == "IR" else (lambda i, j: (c[i] == c[j]) & (c[i] < 4))
        for p, j in _partners(forward[at], at, back[where], where, least, least + 100):
            i = p + least - 1
            d = j - i
            inner = (d <= 2) | ~pair(i + 1, j - 1)
            i, j, d = i[inner], j[inner], d[inner]
            arm, cap = np.full(len(i), least), (101 + 2 * most_arm - d) // 2 + 1
            live = np.arange(len(i))
            while len(live):
                live = live[(arm[live] < cap[live]) & (i[live] - arm[live] >= 0) & (j[live] + arm[live] < n)]
                live = live[pair(i[live] - arm[live], j[live] + arm[live])]
                arm[live] += 1
            out += [(name, x - r + 1, y + r, r) for x, y, r in zip(i.tolist(), j.tolist(), arm.tolist(), strict=True)]
    return out


def tandem_runs(seq: str, own: range | None = None) -> list[tuple[int, int, int]]:
    """Runs (first, last + 1, unit) of letters of ``own`` that are repeated 1..9 letters later: long ones, and those at an end of ``own``."""
    c, out = _bases(seq), []
    own = range(len(c)) if own is None else own
    for unit in range(1, 10):
        stop = min(own.stop, len(c) - unit)
        if stop <= own.start:
            continue
        same = (c[own.start + unit : stop + unit] == c[own.start : stop]) & (c[own.start : stop] < 4)
        d = np.diff(np.r_[0, same.astype(np.int8), 0])
        a, b = np.flatnonzero(d == 1) + own.start, np.flatnonzero(d == -1) + own.start
        keep = (b - a + unit >= max(10, 3 * unit)) | (a == own.start) | (b == own.stop)
        out += [(x, y, unit) for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
    return out


def repeat_regions(seq: str, most_arm: int = 300) -> list[tuple[str, int, int, int]]:
    """Direct, inverted, mirror and short tandem repeats: (class, start, end, arm or unit).

    DR: equal arms of 10..most_arm, at most 10 apart.  IR: an arm of 6 or more and its reverse
    complement, at most 100 apart.  MR: an arm of 10 or more and its reverse, at most 100 apart.
    Arms of both are followed at least as far as most_arm.
    STR: a unit of 1..9 at least 3 times and at least 10 letters.  Only the longest of the repeats with one shift or centre.
    """
    tandem = [(a, b + u, u) for a, b, u in tandem_runs(seq) if b - a + u >= max(10, 3 * u)]
    primitive = lambda a, u: not any(u % v == 0 and seq[a : a + u - v] == seq[a + v : a + u] for v in range(1, u))
    return sorted(bounded_repeats(seq, most_arm) + [("STR", a, b, u) for a, b, u in tandem if primitive(a, u)])


def call(seqs: DataFrame, caller: str, *keep: str, seq: str = "seq", **options: float) -> DataFrame:
    """Hits of g4hunter, zdna or the repeat finder as (keep, class, start, end, strand, score), 0-based and half open."""
    if caller == "repeats":
        regions = lambda text, **o: [(a, b, float(arm), c) for c, a, b, arm in repeat_regions(text, **o)]
    else:
        find, name = {"g4hunter": (g4hunter_regions, "GQ"), "zdna": (zdna_regions, "Z_DNA")}[caller]
        regions = lambda text, **o: [(a, b, s, name) for a, b, s in find(text, **o)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*key, c, a, b, ("+" if s > 0 else "-") if c == "GQ" else ".", s) for *key, text in pdf.itertuples(index=False) for a, b, s, c in regions(text or "", **options)]
            yield pd.DataFrame(rows, columns=[*keep, "class", "start", "end", "strand", "score"])

    schema = seqs.select(*keep).schema
    return seqs.select(*keep, seq).mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), HITS]))


#: Names of all motifs in the order in which tables show them, and those of the interval finder (fixed values).
MOTIF_ORDER, FINDER_MOTIFS = ("GQ", "Z-DNA", "DR", "IR", "MR", "STR"), ("DR", "IR", "MR", "STR")


def tidy(g4: DataFrame, zdna: DataFrame, finder: DataFrame, only: tuple[str, ...] = MOTIF_ORDER) -> DataFrame:
    """The metrics of three callers as one table (pair_id, which, motif, n_hits, bp_covered).

    The first two tables have no motif column, the third one may hold motifs
    that are not the finder's; these are left out, as are motifs not in
    ``only``.  Sides are told by the beginning of their labels; what is no
    number counts as zero.
    """
    all_ = _tidy_rows(g4, F.lit("GQ")).unionByName(_tidy_rows(zdna, F.lit("Z-DNA"))).unionByName(_tidy_rows(finder.where(F.col("motif").isin(*FINDER_MOTIFS)), F.col("motif")))
    return all_.where(F.col("motif").isin(*only))


def _tidy_rows(t: DataFrame, motif: Column) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c)
    return t.select("pair_id", dna.label_of("which").alias("which"), motif.alias("motif"), number("n_hits"), number("bp_covered"))


def tidy_tallies(rows: DataFrame, only: tuple[str, ...] = MOTIF_ORDER) -> DataFrame:
    """The same of one table of all callers with a ``class`` (of ``tiled.tallied``), which is read once."""
    return _tidy_rows(rows, F.when(F.col("class") == "Z_DNA", "Z-DNA").otherwise(F.col("class"))).where(F.col("motif").isin(*only))


def grid(rows: DataFrame, bins: list[int], measures: tuple[str, ...] = ("bp_covered", "n_hits"), motifs: tuple[str, ...] = MOTIF_ORDER, group: str = "grp") -> DataFrame:
    """For every measure and motif, over each bin and (bin null) over all: rows and means of both groups and the difference.

    ``rows`` has motif, bin, the group and the measures.  Grouping sets give bins and
    totals in one pass; a cell of the full grid without rows has zero counts and null means.
    """
    long = rows.select("motif", "bin", group, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))))
    of = lambda f, g: f(F.when(F.col(group) == g, F.col("value")))
    sets = [[F.col("measure"), F.col("motif"), F.col("bin")], [F.col("measure"), F.col("motif")]]
    cells = long.groupingSets(sets, F.col("measure"), F.col("motif"), F.col("bin")).agg(
        F.grouping("bin").alias("_all"), *(of(f, g).alias(f"{name}_{g}") for g in ("natural", "synthetic") for name, f in (("n", F.count), ("mean", F.avg)))
    )
    spark = rows.sparkSession
    full = spark.createDataFrame([(m, t, b, int(b is None)) for m in measures for t in motifs for b in [*bins, None]], "measure string, motif string, bin int, _all int")
    j = stats.joined(full, cells.withColumn("bin", F.col("bin").cast("int")), ["measure", "motif", "bin", "_all"], "left")
    n = [F.coalesce(f"n_{g}", F.lit(0)).alias(f"n_{g}") for g in ("natural", "synthetic")]
    return j.select("measure", "motif", "bin", *n, "mean_natural", "mean_synthetic", (F.col("mean_synthetic") - F.col("mean_natural")).alias("delta"))


def metrics(hits: DataFrame, *by: str) -> DataFrame:
    """n_hits and bp_covered per group; overlaps count twice, groups without hits are absent."""
    return hits.groupBy(*by).agg(F.count("class").alias("n_hits"), F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("bp_covered"))


def zero_filled(rows: DataFrame, entities: DataFrame, motifs: list[str], *by: str) -> DataFrame:
    """A row for every entity and motif."""
    grid = entities.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, motifs))).alias("motif"))
    return grid.join(rows, [*by, "motif"], "left").fillna(0, ["n_hits", "bp_covered"])


def paired(rows: DataFrame, measure: str) -> DataFrame:
    """(pair_id, motif, orig, syn) of the pairs that have both sides."""
    p = rows.groupBy("pair_id", "motif").pivot("which", ["orig", "syn"]).agg(F.sum(measure))
    return p.where(F.col("orig").isNotNull() & F.col("syn").isNotNull()).withColumn("measure", F.lit(measure))


def motif_summary(pairs: DataFrame, eps: float = 0.5) -> DataFrame:
    """Per measure and motif: n, means, medians, log2 ratios, and the mean and median of the pairs' own ratios."""
    ratio = lambda a, b: F.log2((a + eps) / (b + eps))
    return pairs.groupBy("measure", "motif").agg(
        F.count("*").alias("n"), F.avg("orig").alias("mean_orig"), F.avg("syn").alias("mean_syn"), F.median("orig").alias("median_orig"), F.median("syn").alias("median_syn"),
        ratio(F.avg("orig"), F.avg("syn")).alias("log2fc_mean"), ratio(F.median("orig"), F.median("syn")).alias("log2fc_median"),
        F.avg(ratio(F.col("orig"), F.col("syn"))).alias("mean_pair_log2"), F.median(ratio(F.col("orig"), F.col("syn"))).alias("median_pair_log2"),
    )


def significance(pairs: DataFrame) -> DataFrame:
    """Two-sided paired Wilcoxon per measure and motif with q within each measure and its mark."""
    w = stats.wilcoxon_p(pairs.withColumn("_d", F.col("orig") - F.col("syn")), "_d", "measure", "motif")
    return stats.bh(w, "p", ("measure",), tie=("motif",)).withColumn("mark", mark(F.col("q")))


def mark(q):
    return F.when(q < 0.01, "**").when(q < 0.05, "*").when(q < 0.10, "•").otherwise("")


def quartiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """What a box plot shows of each group: n, low, q1, middle, q3, high."""
    at = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).cast("double").alias("low"), at(0.25).alias("q1"), at(0.5).alias("middle"), at(0.75).alias("q3"), F.max(value).cast("double").alias("high"))
