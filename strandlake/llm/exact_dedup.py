"""Exact dedup by a minimal perfect hash over historical digests (operator 4).

The distinct digests of what was ingested before are dealt into buckets by
their leading bits; each bucket gets a minimal perfect hash (levels of bit
arrays, ranked by a running count) whose slots hold the full digest and the
locator of the row that stays.  New digests, already grouped, go to the same
buckets.  A lookup reads one slot and compares all digest bytes: members join
the historical group, the others form groups of their own.

Defined results: a null text counts as empty; of equal texts the one with the
most code points stays, then the smallest id (a null id comes first); repeated
rows with one id are counted each and kept or dropped alike; a text of any
length is read whole; an empty history or batch is allowed; other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, id_in, id_out, materialize, partitions

KEYS_PER_BUCKET = 20_000
GAMMA = 2.0

GROUP = "bucket int, text_sha256 string, n_points long, keep_id long, n long"
INDEX = "bucket int, levels binary, sizes array<int>, digests binary, n_points array<long>, keep_id array<long>, n array<long>"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the digest of the text without white space, and the code points of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_in(id_col).alias("doc_id"),
        F.sha2(F.translate(text, SPACE_CHARS, ""), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_points"),
    )


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def groups(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest: bucket, digest, the winner and the number of rows."""
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").alias("id")))
    return rows.groupBy("text_sha256").agg(best.alias("b"), F.count("*").alias("n")).select(
        bucket_of(F.col("text_sha256"), buckets).alias("bucket"), "text_sha256", (-F.col("b.p")).alias("n_points"), F.col("b.id").alias("keep_id"), "n"
    )


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raw(hexes: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), dtype=np.uint64).reshape(-1, 4)


def _place(d: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(d[:, 2] + np.uint64(level) * (d[:, 3] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def mph_build(d: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each of the distinct keys."""
    levels, slot = [], np.full(len(d), -1, dtype=np.int64)
    rest, base = np.arange(len(d)), 0
    while len(rest):
        size = max(2, int(GAMMA * len(rest)))
        at = _place(d[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        slot[rest[hit]] = base + np.cumsum(alone)[at[hit]] - 1
        base += int(hit.sum())
        levels.append(alone)
        rest = rest[~hit]
    return levels, slot


def mph_lookup(levels: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """The only slot in which each key can be; -1 if no level has its bit."""
    slot, rest, base = np.full(len(d), -1, dtype=np.int64), np.arange(len(d)), 0
    for k, bits in enumerate(levels):
        if not len(rest):
            break
        at = _place(d[rest], k, len(bits))
        hit = bits[at]
        slot[rest[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        rest = rest[~hit]
    return slot


def _index_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    d = _raw(pdf.text_sha256)
    levels, slot = mph_build(d)
    back = np.argsort(slot)
    return pd.DataFrame([{
        "bucket": pdf.bucket.iloc[0], "levels": np.packbits(np.concatenate(levels)).tobytes(), "sizes": [len(x) for x in levels], "digests": d[back].tobytes(),
        "n_points": pdf.n_points.to_numpy()[back], "keep_id": pdf.keep_id.to_numpy()[back], "n": pdf.n.to_numpy()[back],
    }])


def build_index(history: DataFrame) -> DataFrame:
    """One row per bucket: the perfect hash and its slots, in slot order."""
    return history.groupBy("bucket").applyInPandas(_index_bucket, INDEX)


def _merge_bucket(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    if not len(index):
        return new[["bucket", "text_sha256", "n_points", "keep_id", "n"]]
    row = index.iloc[0]
    ends = np.cumsum(row.sizes)
    levels = np.split(np.unpackbits(np.frombuffer(row.levels, dtype=np.uint8))[: ends[-1]].astype(bool), ends[:-1])
    held = np.frombuffer(row.digests, dtype=np.uint64).reshape(-1, 4)
    points, ids, n = (np.array(row[c], dtype=np.int64) for c in ("n_points", "keep_id", "n"))
    d = _raw(new.text_sha256) if len(new) else held[:0]
    slot = mph_lookup(levels, d)
    member = (slot >= 0) & (held[slot] == d).all(axis=1)
    p, i, m, s = new.n_points.to_numpy()[member], new.keep_id.to_numpy()[member], new.n.to_numpy()[member], slot[member]
    wins = (p > points[s]) | ((p == points[s]) & (i < ids[s]))
    points[s[wins]], ids[s[wins]] = p[wins], i[wins]
    n[s] += m
    hexes = held.tobytes().hex()
    old = pd.DataFrame({"bucket": row.bucket, "text_sha256": [hexes[k : k + 64] for k in range(0, len(hexes), 64)], "n_points": points, "keep_id": ids, "n": n})
    return pd.concat([old, new.loc[~member, list(old)]])


def merge(index: DataFrame, new: DataFrame) -> DataFrame:
    """The groups of history and new rows together."""
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(_merge_bucket, GROUP)


def exact_dedup(rows: DataFrame, is_history: Column) -> DataFrame:
    """``rows`` of ``digests`` with keep_id, group_size and kept."""
    rows = materialize(rows)
    spark = rows.sparkSession
    buckets = partitions(spark, rows.count(), KEYS_PER_BUCKET)
    index = build_index(groups(rows.filter(is_history), buckets))
    merged = merge(index, groups(rows.filter(~is_history), buckets)).select(F.col("text_sha256").alias("_d"), "keep_id", F.col("n").alias("group_size"))
    return rows.join(merged, F.col("text_sha256") == F.col("_d")).select(
        id_out("doc_id"), id_out("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "n_points"
    )


def half_history(id_col: str = "doc_id") -> Column:
    """Stands for an earlier ingestion where a table has no mark of one: half of the ids."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
