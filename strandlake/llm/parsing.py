"""Suffix-array dedup by prefix-free parsing (operator 10).

A rolling hash over GRAM bytes marks triggers: places where it falls into one
of MODULUS residue classes.  A text is cut at its triggers into phrases; each
phrase ends with the bytes of its trigger and the next one begins with them,
so no proper ending of a phrase that is longer than a trigger begins another.
The distinct phrases are the dictionary, and the phrases that follow one
another are the parse.

A suffix of a text is an ending of the phrase in which it starts, and then
what follows in the parse.  So the order of all suffixes is the order of
dictionary suffixes, ties broken by the order of what follows:
``combined_order`` sorts the distinct phrases of a group from their ends, once
each however often they occur (neighbours' common endings give equal dictionary
suffixes); ``parse_order`` writes what follows each trigger as ranks of
distinct phrases and sorts these rows of numbers (neighbours' common phrases,
and the common bytes of the first two that differ, give equal parse suffixes);
both are joined.  Phrases are told by digests and compared byte by byte.  Of a
phrase the dictionary holds what the windows of the group cover.  Two strings
of WINDOW bytes are equal if the dictionary suffixes are, and if what follows
agrees as far as the rest of the window.  Of equal strings the first in the
corpus stays.

The suffixes are distributed by their trigger (see ``repeats``): only triggers
that occur again can begin equal strings.  Windows without a trigger lie inside
one long phrase; they are dealt with alike, with the smallest hash inside the
window in place of the trigger.  A trigger that occurs more than HOT times is
compared by 128-bit digests of its single windows.

Defined results: matches never cross texts; a null text counts as empty, and
texts shorter than the window lose nothing; a text of any length is read whole;
a string that overlaps its own earlier occurrence is removed; rows with one id
are taken in the order of their texts, so the later of two equal rows is
removed; a null id comes first; an empty table gives no rows; other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_out
from .repeats import BLOCK, Anchors, Method, Texts, mix, ranges, removed, runs_hash, sliding_min, spans_hash

WINDOW, GRAM, MODULUS = 100, 32, 24
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_TABLE = mix(np.arange(7, 263, dtype=np.uint64)).astype(np.uint32)


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """The 32-bit rolling hash of each run of ``gram`` bytes."""
    out = np.empty(max(0, len(data) - gram + 1), dtype=np.uint32)
    for k in range(0, len(out), BLOCK):
        out[k : k + BLOCK] = runs_hash(_TABLE[data[k : k + BLOCK + gram - 1]], gram)
    return out


def _key(data: np.ndarray, at: np.ndarray, gram: int, salt: int) -> np.ndarray:
    """64 bits of the gram at each place."""
    w = np.lib.stride_tricks.sliding_window_view(data, gram)[at]
    w = np.ascontiguousarray(np.pad(w, ((0, 0), (0, -gram % 8)))).view(np.uint64)
    return mix(mix(w + np.arange(1 + salt, w.shape[1] + 1 + salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1))


def phrases(t: Texts, window: int = WINDOW, gram: int = GRAM, modulus: int = MODULUS) -> Anchors:
    """The triggers that end phrases, and for windows inside a long phrase their own anchors."""
    h, reach = rolling(t.data, gram), window - gram
    at = np.flatnonzero(h < np.uint32((1 << 32) // modulus))
    row = np.searchsorted(t.byte, at, side="right") - 1
    inside = at + gram <= t.byte[row + 1]
    at, row = at[inside], row[inside]
    before = np.r_[-1, at[:-1]]
    lo = np.maximum(np.maximum(before + 1, at - reach), t.byte[row])
    hi = np.minimum(at, t.byte[row + 1] - window)
    own = lo <= hi
    ends = _key(t.data, at[own], gram, 0) if own.any() else np.zeros(0, np.uint64)
    # windows without a trigger: from the last trigger, or the beginning of the text, to short of the next one
    texts = np.flatnonzero(np.diff(t.byte) >= window)
    g_row = np.r_[row, texts]
    g_lo = np.r_[at + 1, t.byte[texts]]
    nxt = np.searchsorted(at, g_lo)
    g_hi = np.minimum(np.r_[at, len(t.data) + window][nxt] - reach - 1, t.byte[g_row + 1] - window)
    some = np.flatnonzero(g_lo <= g_hi)
    order = some[np.argsort(g_lo[some])]
    g_row, g_lo, n = g_row[order], g_lo[order], (g_hi - g_lo + 1)[order]
    if not len(n):
        return Anchors(at[own], row[own], lo[own], hi[own], ends, ends)
    place = ranges(g_lo, n + reach)
    low = sliding_min(h[place].astype(np.uint64) << np.uint64(32) | np.arange(len(place), dtype=np.uint64), reach + 1)
    first = np.cumsum(n + reach) - (n + reach)
    owner = place[(low[ranges(first, n)] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    start, of = ranges(g_lo, n), np.repeat(np.arange(len(n)), n)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])])
    mins = _key(t.data, owner[new], gram, 1)
    parts = (owner[new], g_row[of[new]], start[new], start[np.r_[new[1:] - 1, len(start) - 1]], mins, mins)
    order = np.argsort(np.r_[at[own], owner[new]], kind="stable")
    return Anchors(*(np.r_[a, b][order] for a, b in zip((at[own], row[own], lo[own], hi[own], ends, ends), parts, strict=True)))


def sorted_with_common(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of symbols, and how many first ones each row in this order shares with the one before.

    Rows are padded with zeros, which the comparison of byte strings ignores, so rows that differ only in how many
    zeros they end with are ordered by size first.
    """
    rows = np.ascontiguousarray(rows)
    order = np.argsort(size, kind="stable")
    order = order[np.argsort(rows.view(f"S{rows.shape[1] * rows.itemsize}").ravel()[order], kind="stable")]
    s = rows[order]
    differ = np.pad(s[1:] != s[:-1], ((0, 0), (0, 1)), constant_values=True)
    return order, np.r_[-1, np.minimum(differ.argmax(axis=1), np.minimum(size[order][1:], size[order][:-1]))]


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its class of rows with equal first ``depth`` symbols."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of bytes as rows, with zeros behind them."""
    width = max(1, int(size.max()))
    rows = np.lib.stride_tricks.sliding_window_view(np.pad(data, (0, width)), width)[start]
    return rows * (np.arange(width, dtype=np.int32) < size[:, None].astype(np.int32))


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of bytes, both ends in order, as phrases: the number of each span's phrase, and the first span of each phrase."""
    of, size = pd.factorize(spans_hash(data, start, end))[0], end - start
    first = np.unique(of, return_index=True)[1]
    again = np.flatnonzero(first[of] != np.arange(len(of)))
    blocks = (again[k : k + BLOCK] for k in range(0, len(again), BLOCK))
    if not all((size[k] == size[first[of[k]]]).all() and np.array_equal(_spans(data, start[k], size[k]), _spans(data, start[first[of[k]]], size[k])) for k in blocks):
        of = pd.factorize(np.array([data[i:j].tobytes() for i, j in zip(start, end, strict=True)], dtype=object))[0]  # two phrases have one digest
        first = np.unique(of, return_index=True)[1]
    return of, first


def parse_order(rows: np.ndarray, size: np.ndarray, gram: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of what follows each trigger, and how many first bytes each shares with the one before; both from the parse."""
    (n, width), data = rows.shape, np.ascontiguousarray(rows).ravel()
    at = np.flatnonzero(rolling(data, gram) < np.uint32((1 << 32) // modulus))
    at = at[(at % width > 0) & (at % width + gram <= size[at // width])]
    begin = np.sort(np.r_[np.arange(n) * width, at])
    row = begin // width
    last = np.r_[row[1:] != row[:-1], True]
    end = np.where(last, row * width + size[row], np.r_[begin[1:], 0] + gram)
    of, first = dictionary(data, begin, end)
    length = (end - begin)[first]
    phrase = _spans(data, begin[first], length)
    by_rank = sorted_with_common(phrase, length)[0]
    rank = np.empty(len(first), dtype=np.int64)
    rank[by_rank] = np.arange(1, len(first) + 1)
    place = np.arange(len(begin)) - np.searchsorted(row, np.arange(n))[row]
    parse = np.zeros((n, place.max() + 1), dtype=">u4")  # as bytes its rows sort as their numbers do; 0 is the end
    offset = np.zeros(parse.shape, dtype=np.int32)
    parse[row, place], offset[row, place] = rank[of], begin - row * width
    order = np.argsort(parse.view(f"S{4 * parse.shape[1]}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    j = (parse[a] != parse[b]).argmax(axis=1)
    one, other = parse[a, j].astype(np.int64), parse[b, j].astype(np.int64)
    common = np.minimum(size[a], size[b]).astype(np.int64)
    k = np.flatnonzero((one != other) & (one > 0) & (other > 0))
    x, y = by_rank[one[k] - 1], by_rank[other[k] - 1]
    differ = np.pad(phrase[x] != phrase[y], ((0, 0), (0, 1)), constant_values=True).argmax(axis=1)
    common[k] = offset[a[k], j[k]] + np.minimum(differ, np.minimum(length[x], length[y]))
    return order, np.r_[-1, common]


def combined_order(around: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM, modulus: int = MODULUS) -> np.ndarray:
    """For triggers in corpus order and each number of bytes before them: whether that window occurs earlier."""
    n, reach = len(left), around.shape[1] - window
    before, stop = np.ascontiguousarray(around[:, :reach]), np.arange(1, len(left) + 1) * reach
    phrase, first = dictionary(before.ravel(), stop - left, stop)
    endings = sorted_with_common(before[first][:, ::-1], left[first])
    after, begin = np.ascontiguousarray(around[:, reach:]), np.arange(n) * window
    suffix, once = dictionary(after.ravel(), begin, begin + right)
    follows = parse_order(after[once], right[once], gram, modulus)
    gone = np.zeros((n, reach + 1), dtype=bool)
    for x in range(reach + 1):
        has = np.flatnonzero((left >= x) & (right >= window - x))
        if len(has) > 1:
            both = classes(*endings, x)[phrase[has]] * (n + 1) + classes(*follows, window - x)[suffix[has]]
            gone[has, x] = pd.Series(both).duplicated().to_numpy()
    return gone


def _finish(data: bytes, sym: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    n = int(gone.sum())
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return len(data), n, spans, sha256(sym[~gone].tobytes() if n else data).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, modulus: int = MODULUS, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""
    method = Method(
        words=False, length=window, reach=window - gram, anchors=lambda t: phrases(t, window, gram, modulus), resolve=lambda *a: combined_order(*a, window, gram, modulus),
        within=True, finish=_finish, schema=SCHEMA,
    )
    out = removed(docs, method, id_col, text_col, hot)
    return out.select(id_out("doc_id"), *(F.col(c) for c in out.columns[1:]))
