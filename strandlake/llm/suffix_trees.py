"""Substring dedup by prefix-partitioned suffix trees (operator 7).

The suffixes of the word sequences are split into groups that fit a task by
prefixes of variable length: all repeated prefixes are counted, SHORT words
long where few suffixes share them, PREFIX words where these are too many, and
where even those are, the whole window (compared by 128-bit digests).  Of the
suffixes only a sample is kept: in each run of words the one whose next PREFIX
words have the smallest hash, so that every window of WINDOW words holds a
sampled suffix, at the same place wherever the window occurs (see ``repeats``);
windows that begin before it are told apart by the words before.

In a group the suffixes are sorted, and the number of words that neighbours
share gives the tree: an internal node of depth d is a longest stretch of
leaves whose neighbours share d words or more, some of them just d
(``internal_nodes``).  The leaves below a deep node are sorted once more by the
words before them; the stretches of this order that share x words or more are
its extensions to the left, and such a stretch of a node is a maximal repeat of
x + d words (``deep_nodes``).  It names its smallest document; in all others
the windows that it holds are repeats.

Words are compared by 48 bits of hash each: two windows count as equal if all
their words do.

Defined results: words are the runs between white-space characters; a null
text has none; texts shorter than a window lose nothing; a text of any length
is read whole; a window that is repeated only within one document, or in rows
with the same id, stays; a null id comes first; an empty table gives no rows;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_out
from .parsing import sorted_with_common
from .repeats import AT_ONCE, Anchors, Method, Texts, mix, ranges, removed, runs_hash, sliding_min

WINDOW, PREFIX, SHORT = 50, 14, 7
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _key(sym: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64 bits of the ``n`` words from each place."""
    w = np.lib.stride_tricks.sliding_window_view(sym, n)[at]
    return mix(mix(w + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1))


def sampled_suffixes(t: Texts, window: int = WINDOW, prefix: int = PREFIX, short: int = SHORT) -> Anchors:
    """The suffixes that stand for the windows around them."""
    reach, size = window - prefix, np.diff(t.first)
    if not (size >= window).any():
        return Anchors(*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    h = runs_hash(mix(t.sym).astype(np.uint32), prefix).astype(np.uint64)
    low = sliding_min(h << np.uint64(32) | np.arange(len(h), dtype=np.uint64), reach + 1)
    row = np.repeat(np.arange(len(size)), size)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + window <= t.first[row + 1])
    owner, row = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), row[start]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
    at = owner[new]
    return Anchors(at, row[new], start[new], start[np.r_[new[1:] - 1, len(start) - 1]], _key(t.sym, at, short), _key(t.sym, at, prefix))


def internal_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First leaf, end and depth of each internal node of depth ``least`` or more, from what each leaf shares with the one before."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for depth in np.unique(common[common >= least]):
        edge = np.diff(np.r_[0, common >= depth, 0].astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = np.unique(np.searchsorted(first, np.flatnonzero(common == depth), side="right")) - 1
        parts.append((first[own] - 1, end[own], np.full(len(own), depth, dtype=np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _some_at_once(first: np.ndarray, end: np.ndarray, depth: np.ndarray):
    """The nodes in batches of about AT_ONCE leaves."""
    batch = (np.cumsum(end - first) - 1) // AT_ONCE
    cut = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]) if len(batch) else []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield first[i:j], end[i:j], depth[i:j]


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """The least of each run of 1, 2, 4... values."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least_between(minima: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value from ``lo`` to ``hi``, both included."""
    out, level = np.empty(len(lo), dtype=np.int64), np.frexp(hi - lo + 1)[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(minima[k][lo[at]], minima[k][hi[at] - (1 << int(k)) + 1])
    return out


def deep_nodes(around: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each suffix and each number of words before it: whether that window is also in a smaller document."""
    n, reach = len(left), around.shape[1] - window
    leaves, shared = sorted_with_common(around[:, reach:], right)
    before, alike = sorted_with_common(around[:, :reach][:, ::-1], left)
    rank = np.empty(n, dtype=np.int64)
    rank[before] = np.arange(n)
    minima = _minima(alike)
    change = np.zeros((n, reach + 2), dtype=np.int64)
    for first, end, depth in _some_at_once(*internal_nodes(shared, window - reach)):
        node, leaf = np.repeat(np.arange(len(first)), end - first), leaves[ranges(first, end - first)]
        leaf = leaf[np.lexsort((rank[leaf], node))]
        inside = np.flatnonzero(node[1:] == node[:-1])
        common = np.full(len(leaf), -1, dtype=np.int64)
        common[inside + 1] = _least_between(minima, rank[leaf[inside]] + 1, rank[leaf[inside + 1]])
        lo, hi, x = internal_nodes(common, 0)
        long = x + depth[node[lo]] >= window
        for lo, hi, x in _some_at_once(lo[long], hi[long], x[long]):
            size = hi - lo
            member = leaf[ranges(lo, size)]
            smallest = np.minimum.reduceat(doc[member], np.cumsum(size) - size)
            other = doc[member] != np.repeat(smallest, size)
            fewest = np.maximum(window - depth[node[lo]], 0)
            np.add.at(change, (member[other], np.repeat(fewest, size)[other]), 1)
            np.add.at(change, (member[other], np.repeat(x + 1, size)[other]), -1)
    return np.cumsum(change[:, : reach + 1], axis=1) > 0


def _finish(data: bytes, sym: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    words = data.split()
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), sha256(b" ".join(kept)).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row."""
    method = Method(
        words=True, length=window, reach=window - prefix, anchors=lambda t: sampled_suffixes(t, window, prefix, short), resolve=lambda *a: deep_nodes(*a, window),
        within=False, finish=_finish, schema=SCHEMA,
    )
    out = removed(docs, method, id_col, text_col, hot)
    return out.select(id_out("doc_id"), *(F.col(c) for c in out.columns[1:]))
