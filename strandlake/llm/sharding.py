"""Sharding by sampled splitters (operator 1).

Records are ordered by (hash of the text, id), so equal texts lie together.  A
size-weighted sample of the keys gives quantile boundaries; the records are
dealt into these ranges, and a range that turns out overfull (a hot text, an
unlucky sample) is cut again at quantiles of its own sample, down to the id if
it must be, until all but the largest record of every range is within
OVERFULL times the fair share, or the range has one key only.  Every range then
fits one task, which sums sizes within it; the few range totals complete these
to places in the whole order.  A shard is an
equal stretch of that order in bytes.  A group of equal texts stays in the
shard of its middle byte while it is small against a shard; a larger one is
split.

Defined results: a null text has size 1 and the checksum of an empty one; an
empty text has size 1; ties and repeated rows are all placed, in id order; a
null id comes first; an empty table gives no rows, and fewer rows than shards
leave some shards empty; a text may be longer than a shard; other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_in, id_out, materialize

#: Groups of at most this share of a shard's bytes are never split.
WHOLE_GROUP = 1 / 100
#: Sampled keys for each boundary.
OVERSAMPLE = 32
#: A range this many times its fair share of bytes is cut again.
OVERFULL = 1.5

Key = tuple[int, int]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_in(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def range_of(cuts: list[Key]) -> Column:
    """The number of cuts at or below the key (h, doc_id), by bisection."""
    at = np.array([h for h, _ in cuts], dtype=np.int64)
    ids = np.array([i for _, i in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def find(h: pd.Series, doc_id: pd.Series) -> pd.Series:
        h, doc_id = h.to_numpy(), doc_id.to_numpy()
        out, end = np.searchsorted(at, h, side="left"), np.searchsorted(at, h, side="right")
        tied = np.flatnonzero(end > out)  # a cut inside a group of equal texts
        first = out[tied]
        for lo, hi in set(zip(first.tolist(), end[tied].tolist(), strict=True)):
            own = tied[first == lo]
            out[own] = lo + np.searchsorted(ids[lo:hi], doc_id[own], side="right")
        return pd.Series(out.astype(np.int32))

    return find("h", "doc_id") if cuts else F.lit(0)


def quantile_cuts(sample: list[tuple[int, int, float]], parts: int) -> list[Key]:
    """Keys that cut a weighted sample into ``parts`` of near equal weight."""
    sample = sorted(sample)
    total, seen, cuts = sum(w for *_, w in sample), 0.0, []
    for h, i, w in sample:
        if seen >= (len(cuts) + 1) * total / parts:
            cuts.append((h, i))
            while seen >= (len(cuts) + 1) * total / parts:
                cuts.append((h, i))
        seen += w
    return sorted(set(cuts))


def _sample(rows: DataFrame, total: int, n: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``n`` keys drawn with a chance that grows with the size, each with the bytes it stands for; a fixed draw for a fixed seed.

    A record larger than total / n is drawn for certain, so there are at most 2 n in the mean.
    """
    step = max(1.0, total / n)
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(draw * F.lit(step) < F.col("size")).select("h", "doc_id", "size").collect()
    return [(r.h, r.doc_id, max(step, float(r.size))) for r in drawn]


def splitters(rows: DataFrame, ranges: int) -> list[Key]:
    """Cuts under which every range, its largest record aside, has at most OVERFULL times its share, unless all its rows have one key."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    share, seed = max(1.0, total / ranges), 0
    cuts = sorted({(h, -(2**63)) for h, _ in quantile_cuts(_sample(rows, total, ranges * OVERSAMPLE, 0), ranges)})
    key = F.struct("h", "doc_id")
    while True:
        seed += 1
        sizes = rows.groupBy(range_of(cuts).alias("r")).agg(F.sum("size").alias("b"), F.max("size").alias("most"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        over = {x.r: x for x in sizes.filter((F.col("b") - F.col("most") > OVERFULL * share) & (F.col("lo") != F.col("hi"))).collect()}
        if not over:
            return cuts
        inside = rows.withColumn("r", range_of(cuts)).filter(F.col("r").isin(list(over)))
        found: dict[int, list] = {}
        for h, i, w in _sample(inside, sum(x.b for x in over.values()), OVERSAMPLE * sum(-(-x.b // int(share)) for x in over.values()), seed):
            found.setdefault(bisect_right(cuts, (h, i)), []).append((h, i, w))
        for r, x in over.items():
            new = {c for c in quantile_cuts(found.get(r, []), max(2, round(x.b / share))) if tuple(x.lo) < c <= tuple(x.hi)}
            cuts += new or {tuple(x.hi)}  # a poor sample still parts the range
        cuts = sorted(set(cuts))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    rows = materialize(keyed(docs, id_col, text_col))
    spark = rows.sparkSession
    ranges = ranges or max(8 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(rows, ranges)
    ranged = rows.withColumn("r", range_of(cuts))

    totals = sorted(ranged.groupBy("r").agg(F.sum("size").alias("b")).collect())
    total, before, start = sum(x.b for x in totals), {}, 0
    for x in totals:
        before[x.r], start = start, start + x.b
    bases = spark.createDataFrame(list(before.items()), "r int, base long")  # a row for each range
    ranged = ranged.join(F.broadcast(bases), "r")

    in_range = W.partitionBy("r").orderBy("h", "doc_id", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    in_group = W.partitionBy("r", "h")
    per_shard = max(1.0, total / shards)
    placed = ranged.withColumn("end", F.col("base") + F.sum("size").over(in_range))
    placed = placed.select(
        "*",
        F.sum("size").over(in_group).alias("g_size"),
        (F.max("end").over(in_group)).alias("g_end"),
    )
    middle = F.when(F.col("g_size") <= F.lit(WHOLE_GROUP * per_shard), F.col("g_end") - F.col("g_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(per_shard))).cast("int"))
    placed = materialize(placed.select(
        "doc_id", "size", "text_crc32", "r", "shard",
        (F.row_number().over(W.partitionBy("r", "shard").orderBy("h", "doc_id", "text_crc32")) - 1).cast("long").alias("at"),
    ))

    counts, first = placed.groupBy("shard", "r").count().orderBy("shard", "r").collect(), {}
    ahead: dict[int, int] = {}
    for x in counts:
        first[f"{x.shard}:{x.r}"] = ahead.get(x.shard, 0)
        ahead[x.shard] = ahead.get(x.shard, 0) + x["count"]
    starts = spark.createDataFrame([(*map(int, k.split(":")), v) for k, v in first.items()], "s int, k int, first long")
    return placed.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("r") == F.col("k"))).select(
        id_out("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
