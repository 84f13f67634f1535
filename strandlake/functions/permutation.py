"""Label-shuffle tests that never copy a row.

Shuffling labels over pooled values decides, for each distinct value, how many
of its rows get the first label: a multivariate hypergeometric draw.  So a
replicate costs one number a distinct value.  Values are dealt into blocks by
how many rows are smaller; each replicate first draws the blocks' shares, then,
block by block, those of the values.  Draws are quantiles at uniform numbers
fixed by (seed, replicate, place), the same in every engine.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .stats import joined, value_ranks

#: Rows of values that one task draws for; a value with more is a block of its own size.
BLOCK_ROWS = 1 << 20


def uniform(*key: object) -> float:
    """A number in (0, 1) fixed by the key."""
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def hypergeometric(u: float, total: int, marked: int, drawn: int) -> int:
    """The quantile at ``u`` of how many marked rows are among ``drawn`` of ``total``."""
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if low == high:
        return low
    # what is 40 deviations from the mean has no weight in a double
    mean = drawn * marked / total
    far = 40 * math.sqrt(max(1.0, mean * (1 - marked / total) * (total - drawn) / max(1, total - 1))) + 40
    x = np.arange(max(low, int(mean - far)), min(high, int(mean + far)) + 1)
    ratio = np.log((marked - x[:-1]) * (drawn - x[:-1])) - np.log((x[:-1] + 1) * (total - marked - drawn + x[:-1] + 1.0))
    weight = np.r_[0.0, np.cumsum(ratio)]
    weight = np.exp(weight - weight.max())
    share = np.cumsum(weight) / weight.sum()
    return int(x[min(len(x) - 1, int((share < u).sum()))])


def _shares(counts: list[int], first: int, seed: int, rep: int, place: object) -> list[int]:
    """How many of each count get the first label, of ``first`` in all."""
    left, out = sum(counts), []
    for i, n in enumerate(counts):
        k = hypergeometric(uniform(seed, rep, place, i), left, n, first)
        out.append(k)
        left, first = left - n, first - k
    return out


def label_shuffles(df: DataFrame, value: str, first: Column, reps: int, seed: int, *by: str) -> DataFrame:
    """Two-sided shuffle test of the means of both labels: n1, n2, delta (second minus first), hits and p = (hits + 1) / (reps + 1)."""
    keys = ["_g", *by]
    v = settled(value_ranks(df, value, *by, sums={"_f": F.count_if(first)}).withColumn("_g", F.lit(0)).withColumn("_block", F.floor(F.col("_less") / BLOCK_ROWS)))
    x = F.col(value).cast("double")
    real = v.groupBy(*keys).agg(
        F.sum("_f").alias("n1"), F.sum(F.col("_n") - F.col("_f")).alias("n2"), F.sum(x * F.col("_f")).alias("_s1"), F.sum(x * (F.col("_n") - F.col("_f"))).alias("_s2")
    ).where((F.col("n1") > 0) & (F.col("n2") > 0))
    blocks = joined(v.groupBy(*keys, "_block").agg(F.sum("_n").alias("_rows")), real.select(*keys, "n1"), keys)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema]

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block").reset_index(drop=True)
        counts, n1 = pdf["_rows"].tolist(), int(pdf["n1"].iloc[0])
        out = pd.concat([pdf[[*keys, "_block"]].assign(_rep=r, _k=_shares(counts, n1, seed, r, "block")) for r in range(reps)])
        return out

    def over_values(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rep", value])
        rows = []
        for r, own in pdf.groupby("_rep"):
            k = _shares(own["_n"].tolist(), int(own["_k"].iloc[0]), seed, int(r), int(own["_block"].iloc[0]))
            rows.append((int(r), float((own[value].astype(float) * k).sum())))
        head = pdf.iloc[:1][keys]
        return pd.concat([head.assign(_rep=r, _sum=s) for r, s in rows])

    if not reps:
        raise ValueError("a shuffle test needs replicates")
    drawn = blocks.groupBy(*keys).applyInPandas(over_blocks, ", ".join([*kinds, "_block long, _rep int, _k long"]))
    each = joined(v.select(*keys, "_block", value, "_n"), drawn, [*keys, "_block"])
    sums = each.groupBy(*keys, "_block").applyInPandas(over_values, ", ".join([*kinds, "_rep int, _sum double"])).groupBy(*keys, "_rep").agg(F.sum("_sum").alias("_sum"))
    both = joined(sums, real, keys)
    gap = lambda s1, s2: F.abs(s2 / F.col("n2") - s1 / F.col("n1"))
    hit = gap(F.col("_sum"), F.col("_s1") + F.col("_s2") - F.col("_sum")) >= gap(F.col("_s1"), F.col("_s2")) - 1e-12
    g = both.groupBy(*keys, "n1", "n2", "_s1", "_s2").agg(F.count_if(hit).alias("hits"))
    return g.select(*by, "n1", "n2", (F.col("_s2") / F.col("n2") - F.col("_s1") / F.col("n1")).alias("delta"), "hits", ((F.col("hits") + 1) / F.lit(reps + 1.0)).alias("p"))
