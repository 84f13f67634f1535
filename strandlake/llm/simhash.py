"""SimHash near-dedup by a binary trie self-join (operator 8).

Fingerprints within 4 bits of one another share at least two of six blocks of
bits exactly.  For each of the 15 pairs of blocks the fingerprints are put in
an order of bits that has these two blocks first: the shuffle key is then the
path through the top levels of a binary trie, on which no bit may differ, and
each task walks the subtrees below.  The walk keeps pairs of nodes, splits
both by the next bit, adds one to a pair's differing bits where they part, and
drops a pair beyond the budget.  From each subtree only a spanning forest of
the links leaves the task.  Connected components over all forests give the
groups.

Equal fingerprints are one node from the start.  A key that very many
different fingerprints share is dealt to pairs of chunks, so that no task
takes it whole.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; fewer words than a shingle count as one shingle; repeated rows and
equal texts share a component; a null id counts as the smallest; a text of any
length is read whole; an empty table gives no rows; other columns are ignored,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_in, id_out, materialize, partitions
from .components import connected_components

SHINGLE, SEED, BITS = 4, 42, 4
#: First bit and number of bits of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
#: Rows of one task's group, and different fingerprints under one key beyond which it is dealt to chunks.
ROWS_PER_GROUP, HOT = 100_000, 8_000
PAIRS_AT_ONCE = 1 << 20

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each run of ``shingle`` words, in order; none of a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(start))


def folded(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 17):
        lanes = h[k : k + (1 << 17)].view(np.uint8).reshape(-1, 8) + _LANE
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    return folded(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": np.array([fingerprint(t) for t in pdf.text], dtype=np.uint64).view(np.int64)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    return docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_fingerprints, "doc_id long, fp long")


def permuted(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fingerprints with the two blocks of their table rotated to the top, the other bits below."""
    out = np.zeros_like(fp)
    for t, pair in enumerate(TABLES):
        at = table == t
        x, y = fp[at], np.zeros(int(at.sum()), dtype=np.uint64)
        for b in (*pair, *(b for b in range(len(BLOCKS)) if b not in pair)):
            low, n = BLOCKS[b]
            y = (y << np.uint64(n)) | ((x >> np.uint64(low)) & np.uint64((1 << n) - 1))
        out[at] = y
    return out


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a and b; label[x] <= x is the class of x."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not (label[label] == label).all():
            label = label[label]


def trie_forest(keys: np.ndarray, group: np.ndarray, depth: int = 64, budget: int = BITS) -> np.ndarray:
    """Labels of the components of keys within ``budget`` differing bits and the same group.

    ``keys`` (uint64) are sorted within sorted groups, the bits on which a group agrees first.
    """
    n, label = len(keys), np.arange(len(keys))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.array([], dtype=np.int64)
    last = np.r_[first[1:], n]
    at = last - first > 1
    root = np.stack([first[at], last[at], first[at], last[at], np.zeros(int(at.sum()), dtype=np.int64), np.full(int(at.sum()), depth - 1)])
    stack = [root]
    while stack:
        p = stack.pop()
        if p.shape[1] > PAIRS_AT_ONCE // 8:
            half = p.shape[1] // 2
            stack += [p[:, :half], p[:, half:]]
            continue
        a0, a1, b0, b1, diff, bit = p
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():
            s = p[:, small]
            w = s[3] - s[2]
            n_pairs = (s[1] - s[0]) * w
            which = np.repeat(np.arange(s.shape[1]), n_pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
            i, j = s[0][which] + k // w[which], s[2][which] + k % w[which]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            label = _union(label, i[near], j[near])
        a0, a1, b0, b1, diff, bit = p[:, ~small]
        if not len(a0):
            continue

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """First key of lo..hi whose bit is set, by bisection of all nodes at once."""
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                is_one = (keys[np.minimum(mid, n - 1)] >> bit.astype(np.uint64)) & np.uint64(1) == 1
                hi = np.where(open_ & is_one, mid, hi)
                lo = np.where(open_ & ~is_one, mid + 1, lo)
            return lo

        am, bm = split(a0, a1), split(b0, b1)
        same = a0 == b0
        parts = []
        for x0, x1, y0, y1, d, keep in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (diff + d <= budget)
            ok &= ~((x0 == y0) & (x1 - x0 == 1))
            if keep is not None:
                ok &= keep
            parts.append(np.stack([x0, x1, y0, y1, diff + d, bit - 1])[:, ok])
        nxt = np.concatenate(parts, axis=1)
        alike = (nxt[5] < 0)  # equal keys
        if alike.any():
            e = nxt[:, alike]
            for x0, x1, y0, y1 in e[:4].T:
                members = np.r_[np.arange(x0, x1), np.arange(y0, y1)]
                label = _union(label, members, np.full(len(members), members[0]))
            nxt = nxt[:, ~alike]
        if nxt.shape[1]:
            stack.append(nxt)
    return label


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    fp = pdf.fp.to_numpy().view(np.uint64)
    key = permuted(fp, pdf.t.to_numpy())
    group = pd.factorize(pd.MultiIndex.from_arrays([pdf.t, pdf.key, pdf.chunk]))[0]
    order = np.lexsort((key, group))
    label = trie_forest(key[order], group[order])
    own = pdf.fp.to_numpy()[order]
    linked = label != np.arange(len(label))
    return pd.DataFrame({"a": own[linked], "b": own[label[linked]]}).drop_duplicates()


def links(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` (fp, distinct) -> (a, b): links that connect all fingerprints within the budget of each other."""

    def block(b: int):
        low, n = BLOCKS[b]
        return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << n) - 1))

    tables = F.array(*(F.struct(F.lit(t).alias("t"), (block(i) * 2048 + block(j)).alias("key")) for t, (i, j) in enumerate(TABLES)))
    paths = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    hot = materialize(paths.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("t", "key", F.ceil(2 * F.col("n") / HOT).cast("int").alias("chunks")))
    if hot.isEmpty():
        dealt = paths.withColumn("chunk", F.lit(0))
    else:
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, chunk) * F.col("chunks") + F.greatest(c, chunk) + 1)
        dealt = paths.join(hot, ["t", "key"], "left").select("fp", "t", "key", F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("chunk"))
    groups = partitions(nodes.sparkSession, rows * len(TABLES), ROWS_PER_GROUP)
    group = F.pmod(F.xxhash64("t", "key", "chunk"), F.lit(groups)).cast("int")
    return dealt.groupBy(group.alias("g")).applyInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id for each row."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(nodes.select("fp"), nodes.count()))
    known = materialize(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = materialize(known.groupBy("root").agg(F.min("first").alias("component")))
    component = materialize(known.join(best, "root").select(F.col("fp").alias("_fp"), "component"))
    discard(nodes)
    return rows.join(component, F.col("fp") == F.col("_fp")).select(id_out("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("component").alias("component_id"))
