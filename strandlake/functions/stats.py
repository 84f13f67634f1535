"""Statistics as grouped plans: ranks, tests, false-discovery control and counter-based resampling."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settled


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the keys stay once."""
    other = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_ranks(df: DataFrame, value: str, *by: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row for each value (not null) of each ``by``: _n rows with it, _less rows with a smaller one, _m rows in all, and further ``sums``.

    Rows are counted by value first.  Values are dealt into ranges by their
    quantiles; running sums over the ranges of a ``by``, and over the values of
    one range, give the counts below.  So no task sorts all of a group.
    """
    keys = ["_g", *by]
    rows = df.where(F.col(value).isNotNull()).withColumn("_g", F.lit(0))
    counted = settled(rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), *(c.alias(k) for k, c in (sums or {}).items())))
    n = _ranges(df)
    edges = counted.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)] or [0.5], 10_000).alias("_e"))
    ranged = counted.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value).cast("double")))).drop("_e")  # one row
    return _running(ranged, keys, [value]).drop("_g", "_b")


def _running(ranged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with _n and their range _b -> _less, the sum of _n before them within ``keys``, and _m, the sum of all."""
    whole = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(whole).alias("_m"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn("_less", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return joined(own, totals, [*keys, "_b"]).withColumn("_less", F.col("_less") + F.col("_before")).drop("_before")


def hash_places(df: DataFrame, seed: int, key: str, *by: str) -> DataFrame:
    """Adds _r, each row's place from 1 within ``by`` in the order of a hash of the key, and _m, the rows of ``by``.

    Hashes are dealt into equal ranges, so rows are numbered range by range.
    """
    keys = ["_g", *by]
    n = _ranges(df)
    hashed = df.withColumn("_g", F.lit(0)).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).withColumn("_n", F.lit(1))
    ranged = hashed.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * n / 2**32).cast("int"))
    return _running(ranged, keys, ["_h", key]).withColumn("_r", F.col("_less") + 1).drop("_g", "_h", "_n", "_b", "_less")


def bh(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), q: str = "q", tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds Benjamini-Hochberg q-values within ``by``; null p stays null.

    Equal p have equal q, so q is found for each distinct p and joined back; ``tie`` is not needed for that.
    """
    keys = ["_g", *by]
    n, df = _ranges(df), settled(df)
    ranks = value_ranks(df, p, *by).withColumn("_g", F.lit(0)).withColumn("_v", F.col(p) * F.col("_m") / (F.col("_less") + F.col("_n")))
    # the least of all values from here on: within a range of ranks, then over the later ranges
    ranged = ranks.withColumn("_b", F.floor(F.col("_less") * n / F.col("_m")).cast("int"))
    least = ranged.groupBy(*keys, "_b").agg(F.min("_v").alias("_t"))
    least = least.select(*keys, "_b", F.min("_t").over(W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    own = ranged.withColumn("_v", F.min("_v").over(W.partitionBy(*keys, "_b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)))
    found = joined(own, least, [*keys, "_b"]).select(*by, p, F.least(F.lit(1.0), F.least("_v", "_after")).alias(q))
    return joined(df, found, [*by, p], "left")


def wilcoxon(df: DataFrame, diff: str, *by: str) -> DataFrame:
    """Signed-rank statistic of ``diff`` per group, zeros dropped: n, w_plus, and the tie-corrected normal z."""
    d = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(diff))
    r = value_ranks(d, "_a", *by, sums={"_up": F.count_if(F.col(diff) > 0)})
    k = F.col("_n")
    g = r.groupBy(*by).agg(F.sum(k).alias("n"), F.sum(F.col("_up") * (F.col("_less") + (k + 1) / 2)).alias("w_plus"), F.sum(k * (k * k - 1)).alias("_ties"))
    if not by:  # one row also of nothing
        g = g.select(F.coalesce("n", F.lit(0)).alias("n"), "w_plus", "_ties")
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    return g.select(*by, "n", "w_plus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var)).alias("z"), (F.col("_ties") > 0).alias("tied"))


def wilcoxon_p(df: DataFrame, diff: str, *by: str, two_sided: bool = True) -> DataFrame:
    """n, w_plus, z and p per group; exact for up to 50 differences without ties or zeros, else by the normal curve; 1 if all differences are zero."""
    every = df.where(F.col(diff).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    w = wilcoxon(df, diff, *by)
    j = every.join(w, [*by], "left") if by else every.crossJoin(w)
    n = F.coalesce("n", F.lit(0))
    tail = F.when(F.col("z") == 0, 0.5).otherwise(normal_sf(F.abs("z") if two_sided else F.col("z")))
    normal = F.least(F.lit(1.0), 2 * tail) if two_sided else tail
    exact = signed_rank_sf(F.greatest("w_plus", n * (n + 1) / 2 - F.col("w_plus")) if two_sided else F.col("w_plus"), n)
    exact = F.least(F.lit(1.0), 2 * exact) if two_sided else exact
    p = F.when(n == 0, F.lit(1.0)).when((n <= 50) & ~F.col("tied") & (n == F.col("_all")), exact).otherwise(normal)
    return j.select(*by, n.alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "z", p.alias("p"))


def sign_test(df: DataFrame, diff: str, *by: str) -> DataFrame:
    """One-sided sign test that differences tend to be positive: n without zeros, positives, p (1 without any)."""
    g = df.groupBy(*by).agg(F.count_if(F.col(diff) != 0).alias("n"), F.count_if(F.col(diff) > 0).alias("k"))
    return g.select(*by, "n", "k", binomial_sf("k", "n", F.lit(0.5)).alias("p"))


def location_p(df: DataFrame, value: str, delta: float, *by: str) -> DataFrame:
    """Whether values tend to exceed ``delta``: the signed-rank p, or the sign test's where there is none, with the test's name; mean, median and n."""
    d = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lit(delta))
    size = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    w = wilcoxon_p(d, "_d", *by, two_sided=False).select(*by, F.col("p").alias("_w"))
    s = sign_test(d, "_d", *by).select(*by, F.col("p").alias("_s"))
    j = size.join(w, [*by], "left").join(s, [*by], "left") if by else size.crossJoin(w).crossJoin(s)
    return j.select(*by, "n", "mean", "median", F.coalesce("_w", "_s").alias("p"), F.when(F.col("_w").isNotNull(), "wilcoxon").otherwise("sign").alias("test"))


def mann_whitney(df: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """U of the rows where ``first`` holds against the others, per group: n1, n2, u, and the tie-corrected z with continuity."""
    r = value_ranks(df, value, *by, sums={"_f": F.count_if(first)})
    k = F.col("_n")
    g = r.groupBy(*by).agg(
        F.sum("_f").alias("n1"), F.sum(k - F.col("_f")).alias("n2"), F.sum(F.col("_f") * (F.col("_less") + (k + 1) / 2)).alias("_rank"), F.sum(k * (k * k - 1)).alias("_ties")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("_rank") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("_ties"), n * (n - 1)), F.lit(0.0))))
    away = u - n1 * n2 / 2
    both = (n1 > 0) & (n2 > 0)
    return g.select(*by, "n1", "n2", F.when(both, u).alias("u"), F.when(both, F.try_divide(away - F.signum(away) * 0.5, sd)).alias("z"), (F.col("_ties") > 0).alias("tied"))


def mann_whitney_p(df: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """Two-sided p with n1, n2, u and z: exact if a side has 8 rows at most and nothing is tied; null without both sides, 1 if all values are equal."""
    m = mann_whitney(df, value, first, *by)
    top = F.greatest("u", F.col("n1") * F.col("n2") - F.col("u"))
    normal = F.when(F.col("z").isNull(), 1.0).otherwise(2 * normal_sf(F.abs("z")))
    few = (F.least("n1", "n2") <= 8) & ~F.col("tied") & (F.greatest("n1", "n2") <= 2000)
    p = F.when(F.col("u").isNotNull(), F.least(F.lit(1.0), F.when(few, 2 * rank_sum_sf(top, "n1", "n2")).otherwise(normal)))
    return m.select(*by, "n1", "n2", "u", "z", p.alias("p"))


#: Coefficients of the Chebyshev fit of the complementary error function with a relative error below 1.2e-7 everywhere (fixed published values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_sf(z: Column | str) -> Column:
    """P(Z >= z), as a plain expression."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    tail = t * F.exp(-x * x + series) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


@cache
def _subset_sums(n: int) -> np.ndarray:
    """The chance of each rank sum or more, if each of the ranks 1..n counts with chance 1/2."""
    p = np.ones(1)
    for k in range(1, n + 1):
        p = (np.pad(p, (0, k)) + np.pad(p, (k, 0))) / 2
    return np.cumsum(p[::-1])[::-1]


@cache
def _rank_sums(n1: int, n2: int) -> np.ndarray:
    """The chance of each U or more among n1 and n2 values without ties."""
    few, many = sorted((n1, n2))
    p = np.zeros((few + 1, few * many + 1))  # subsets of a size, by what their ranks exceed the least ones
    p[0, 0] = 1.0
    for r in range(few + many):  # a value of rank r is chosen as number j: it exceeds by r - j
        for j in range(min(few, r + 1) - 1, -1, -1):
            if (d := r - j) <= many:
                p[j + 1, d:] += p[j, : p.shape[1] - d]
    return np.cumsum(p[few][::-1])[::-1] / p[few].sum()


@F.pandas_udf(T.DoubleType())
def signed_rank_sf(w: pd.Series, n: pd.Series) -> pd.Series:
    """P(W >= w) of the signed-rank statistic without ties; null beyond 50."""
    return pd.Series([float(_subset_sums(int(b))[int(a)]) if a == a and b <= 50 and a == int(a) else None for a, b in zip(w, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_sf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """P(U >= u) without ties; null where both sides are large."""
    ok = lambda a, x, y: a == a and 0 < min(x, y) <= 8 and max(x, y) <= 2000 and a == int(a)
    return pd.Series([float(_rank_sums(int(x), int(y))[int(a)]) if ok(a, x, y) else None for a, x, y in zip(u, n1, n2, strict=True)], dtype="float64")


@cache
def _log_factorials(size: int) -> np.ndarray:
    """log n! for n below a power of two."""
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, size)))]


def _log_factorial(top: int) -> np.ndarray:
    return _log_factorials(1 << max(10, int(top + 1).bit_length()))


@F.pandas_udf(T.DoubleType())
def binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of a binomial, summed in log space."""

    def one(k: int, n: int, p: float) -> float:
        if k <= 0 or k > n:
            return float(k <= 0)
        f, j = _log_factorial(n), np.arange(k, n + 1)
        return min(1.0, math.fsum(np.exp(f[n] - f[j] - f[n - j] + j * math.log(p) + (n - j) * math.log1p(-p)).tolist()))

    return pd.Series([one(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


#: Up to this total, logarithms of factorials come from a table; beyond it the far tails, which have no weight, are left out too.
FISHER_TABLE = 1 << 22


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact test of [[a, b], [c, d]]: all tables no likelier than this one."""

    def one(a: int, b: int, c: int, d: int) -> float:
        r1, r2, c1 = a + b, c + d, a + c
        x = np.arange(max(0, c1 - r2), min(r1, c1) + 1)
        if r1 + r2 < FISHER_TABLE:
            f = _log_factorial(r1 + r2)
            lp = f[r1] + f[r2] + f[c1] + f[r1 + r2 - c1] - f[r1 + r2] - f[x] - f[r1 - x] - f[c1 - x] - f[r2 - c1 + x]
        else:  # by the ratios of neighbouring tables, from the least x on
            ratio = np.log((r1 - x[:-1]) * (c1 - x[:-1] + 0.0)) - np.log((x[:-1] + 1.0) * (r2 - c1 + x[:-1] + 1))
            lp = np.r_[0.0, np.cumsum(ratio)]
            lp -= lp.max() + math.log(np.exp(lp - lp.max()).sum())
        return min(1.0, math.fsum(np.exp(lp[lp <= lp[a - x[0]] + 1e-7]).tolist()))

    return pd.Series([one(*(int(v) for v in row)) for row in zip(a, b, c, d, strict=True)])


def draw(seed: Column | int, *key: Column) -> Column:
    """A whole number below 2 ** 32 fixed by the seed and the key, the same in every engine with md5."""
    parts = [F.lit(seed) if isinstance(seed, int) else seed, *key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(df: DataFrame, value: str, order: str, reps: int, seed: int, *by: str) -> DataFrame:
    """``reps`` resamples with replacement of each group: (by, rep, value); draws are a function of (seed, rep, position)."""
    part = [F.col(c) for c in by] or [F.lit(1)]
    rows = df.select(*by, value, (F.row_number().over(W.partitionBy(*part).orderBy(order)) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(*part)).alias("_n"))
    drawn = rows.select(*by, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = drawn.select(*by, "rep", (draw(seed, F.col("rep"), F.col("_i")) % F.col("_n")).cast("int").alias("_i"))
    return drawn.join(rows.drop("_n"), [*by, "_i"]).select(*by, "rep", value)


def sign_flips(df: DataFrame, value: str, order: str, reps: int, seed: int) -> DataFrame:
    """Two-sided sign-flip test of the mean: n, mean and p = (hits + 1) / (reps + 1)."""
    rows = df.select(F.col(value).alias("_v"), (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(order)) - 1).alias("_i"))
    flips = rows.select("_v", "_i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    sign = F.when(draw(seed, F.col("rep"), F.col("_i")) % 2 == 0, 1.0).otherwise(-1.0)
    means = flips.groupBy("rep").agg(F.avg(sign * F.col("_v")).alias("m"))
    real = rows.agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    hits = means.crossJoin(F.broadcast(real)).groupBy("n", "mean").agg(F.count_if(F.abs("m") >= F.abs("mean") - 1e-12).alias("hits"))
    return hits.select("n", "mean", ((F.col("hits") + 1) / (reps + 1)).alias("p"))
