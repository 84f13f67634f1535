"""Passes over a corpus that the two substring operators share.

A text is a row of symbols (bytes or words); a window is a fixed number of
consecutive symbols of one text.  An operator names anchors: places in a text
that the text around them decides, such that every window owns one, the same
one wherever the window occurs.  Around its anchor a window reaches some
symbols to the left and the rest to the right.  The passes are

1.  Texts are written once, bucketed by ``chunk`` (a hash of the id).  Every
    later pass reads that table in place: no text is shuffled again.
2.  Each chunk sends the keys of its anchors (hashes of the symbols that
    follow), packed, to be counted.  A window can only occur twice if its
    anchor's key does.
3.  Anchors whose key occurs again send what surrounds them, once for each
    chunk and surroundings.  ``levels`` of the operator decide by which prefix
    they are grouped; at the last level an anchor sends 128-bit digests of its
    single windows instead, so that no task takes all of a hot key.
4.  The operator resolves equal windows among the anchors of one group.
5.  Each chunk marks what is removed and digests what is left.

The tables of a call are deleted when it ends, also by an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, discard, id_in, materialize, per_process, shared_dir

#: Text of a chunk; of a group of anchors; anchor keys counted in one group; text of a table bucket.
CHUNK_BYTES, GROUP_BYTES, COUNT_BYTES, TABLE_BYTES = 4 << 20, 8 << 20, 128 << 20, 128 << 20
#: Anchors with one key, or one short prefix, beyond which the next level is used.
HOT = 20_000
#: Anchors whose surroundings are in memory at once.
AT_ONCE = 1 << 17
#: Bytes hashed at once, so that the steps stay in a processor's cache.
BLOCK = 1 << 16

KEYS = "bucket int, chunk int, gs binary, ps binary, ns binary"
NOTES = "chunk int, gs binary, level binary, rep int, bits binary"
RECORDS = "bucket int, chunk int, rep int, single boolean, g long, doc long, ord int, at long, left int, right int, hull binary"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared and so on; kept for the worker's next call."""
    kept = per_process(f"powers of {base}", dict)
    if len(kept.get("p", ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        kept["p"] = np.multiply.accumulate(out)
    return kept["p"][:n]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of the spans, which are in order, by differences of a running sum over some of them at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK)))
        a, z = start[i], end[j - 1]
        total = np.zeros(z - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[a:z]] * powers(_P, z - a), out=total[1:])
        out[i:j] = mix((total[end[i:j] - a] - total[start[i:j] - a]) * powers(_P_INVERSE, z - a + 1)[start[i:j] - a])
        i = j
    return out


def runs_hash(sym: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each run of ``n`` symbols (32-bit values), by doubling: runs of 1, 2, 4... are joined."""
    out, done, piece, size = None, 0, sym, 1
    while True:
        if n & size:
            m = len(sym) - n + 1
            part = piece[done : done + m]
            out = part if out is None else out * np.uint32(0x85EBCA6B) + part
            done += size
        if 2 * size > n:
            break
        piece = piece[:-size] * np.uint32((0x9E3779B1 * (2 * size + 1)) % (1 << 32) | 1) + piece[size:]
        size *= 2
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return out ^ (out >> np.uint32(16))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """min(a[i : i + w]) for each i."""
    n = len(a)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range, one range after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - (end - size), size)


@dataclass
class Texts:
    """The texts of a chunk in the order of their ids as one row of symbols."""

    docs: np.ndarray
    ords: np.ndarray
    data: np.ndarray
    #: Where texts begin in ``data``, and, of symbols, in ``sym``.
    byte: np.ndarray
    sym: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, words: bool) -> Texts:
        docs = table.column("doc_id").to_numpy().astype(np.int64)
        text = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
        order = np.argsort(docs, kind="stable")
        if len(np.unique(docs)) < len(docs):
            order = np.array(sorted(range(len(docs)), key=lambda k: (docs[k], text[k].as_py())))
        text, docs = text.take(pa.array(order)), docs[order]
        same = np.r_[False, docs[1:] == docs[:-1]]
        at = np.arange(len(docs))
        ords = at - np.maximum.accumulate(np.where(same, 0, at))
        byte = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[byte[0] : byte[-1]]
        byte = byte - byte[0]
        return cls(docs, ords, data, byte, *(cls.split(data, byte) if words else (data, byte)))

    @staticmethod
    def split(data: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """48 bits of hash of each word, and where each text's words begin."""
        inside = (data != 32) & ((data < 9) | (data > 13))
        cut = np.zeros(len(data) + 1, dtype=bool)  # a text ends the word before it
        cut[byte] = True
        begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | cut[1:-1]][: len(data)])
        end = np.flatnonzero(inside & np.r_[~inside[1:] | cut[1:-1], True][: len(data)]) + 1
        return spans_hash(data, begin, end) >> np.uint64(16), np.searchsorted(begin, byte)


@dataclass(frozen=True)
class Anchors:
    """Sorted places, the row of their text, the first and last window that each owns, a short and a full key."""

    at: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    p: np.ndarray
    g: np.ndarray

    def where(self, keep: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, c)[keep] for c in ("at", "row", "lo", "hi", "p", "g")))


@dataclass(frozen=True)
class Method:
    """What an operator adds to the passes."""

    words: bool
    length: int
    #: The most symbols of a window before its anchor.
    reach: int
    anchors: Callable[[Texts], Anchors]
    #: (surroundings, left, right, doc) in corpus order -> for each anchor and number of symbols before it, whether the window is removed.
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: Whether an equal window in the same text or id counts.
    within: bool
    finish: Callable[[bytes, np.ndarray, np.ndarray], tuple]
    schema: str


def covered(left: np.ndarray, right: np.ndarray, m: Method) -> np.ndarray:
    """Which columns of the surroundings the windows of each anchor cover."""
    col = np.arange(m.reach + m.length, dtype=np.int16)
    left, right = (m.reach - left).astype(np.int16), (m.reach + right).astype(np.int16)
    return (col >= left[:, None]) & (col < right[:, None])


def around(sym: np.ndarray, a: Anchors, m: Method) -> np.ndarray:
    """The surroundings of anchors, one row each; zero outside of what their windows cover."""
    if not len(a.at):
        return np.zeros((0, m.reach + m.length), dtype=sym.dtype)
    first = int(a.at[0])
    padded = np.pad(sym[max(0, first - m.reach) : int(a.at[-1]) + m.length], (max(0, m.reach - first), m.length))
    out = np.lib.stride_tricks.sliding_window_view(padded, m.reach + m.length)[a.at - first]
    return out * covered(a.at - a.lo, a.hi + m.length - a.at, m)


def row_hash(rows: np.ndarray, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row and its extent."""
    short = -rows.shape[1] * rows.itemsize % 8
    w = rows if rows.itemsize == 8 else np.ascontiguousarray(np.pad(rows, ((0, 0), (0, short)))).view(np.uint64)
    w = mix(w ^ (np.arange(1, w.shape[1] + 1, dtype=np.uint64) * _P))
    extent = mix((a.at - a.lo).astype(np.uint64) << np.uint64(32) | (a.hi - a.at + (1 << 20)).astype(np.uint64))
    return w.sum(axis=1) ^ extent, (w * (powers(_P, w.shape[1]) | np.uint64(1))).sum(axis=1) + extent


def first_of(key: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For each place the first one with an equal key (a pair of keys, if there are two)."""
    code = pd.factorize(key)[0]
    top = np.maximum.accumulate(code) if len(code) else code
    first = np.flatnonzero(np.r_[True, top[1:] > top[:-1]][: len(code)])[code]
    if other is not None and (other[first] != other).any():
        return first_of(pd.factorize(pd.MultiIndex.from_arrays([key, other]))[0])
    return first


def window_digests(rows: np.ndarray, a: Anchors, m: Method) -> tuple[np.ndarray, ...]:
    """128 bits of each single window: hash, second hash, row, and symbols before the anchor."""
    base = (_P, np.uint64(0xD6E8FEB86659FD93))
    inverse = [np.uint64(pow(int(b), -1, 1 << 64)) for b in base]
    v = mix(rows.astype(np.uint64) + _P)
    sums = [np.pad(np.cumsum(v * powers(b, v.shape[1]), axis=1), ((0, 0), (1, 0))) for b in base]
    out = []
    for x in range(m.reach + 1):
        k = np.flatnonzero((a.at - x >= a.lo) & (a.at - x <= a.hi))
        c = m.reach - x
        h = [mix((s[k, c + m.length] - s[k, c]) * powers(i, c + 1)[c]) for s, i in zip(sums, inverse, strict=True)]
        out.append((*h, k, np.full(len(k), x)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@dataclass
class Found:
    """The anchors of a chunk whose key occurs again, with one representative for equal surroundings."""

    a: Anchors
    level: np.ndarray
    first: np.ndarray  # of each anchor: its representative
    single: tuple[np.ndarray, ...]  # windows of representatives at the last level: hashes, representative, symbols before it
    first_single: np.ndarray

    @classmethod
    def of(cls, t: Texts, notes: pa.Table, m: Method) -> Found | None:
        told = notes.filter(pa.compute.is_valid(notes.column("gs")))
        gs = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in told.column("gs").to_pylist()] or [np.zeros(0, np.uint64)])
        level = np.concatenate([np.frombuffer(b, dtype=np.uint8) for b in told.column("level").to_pylist()] or [np.zeros(0, np.uint8)])
        if not len(gs):
            return None
        order = np.argsort(gs)
        gs, level = gs[order], level[order]
        a = m.anchors(t)
        at = np.minimum(np.searchsorted(gs, a.g), len(gs) - 1)
        hit = gs[at] == a.g
        a, level = a.where(hit), level[at[hit]]
        h = [row_hash(around(t.sym, b, m), b) for b in _blocks(a)] or [(np.zeros(0, np.uint64),) * 2]
        first = first_of(*(np.concatenate(c) for c in zip(*h, strict=True)))
        hot = np.flatnonzero((level == 2) & (first == np.arange(len(first))))
        found = [window_digests(around(t.sym, b, m), b, m) for b in _blocks(a.where(hot))]
        if not found:
            return cls(a, level, first, (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64))
        h1, h2, k, x = (np.concatenate(c) for c in zip(*((h1, h2, k + n * AT_ONCE, x) for n, (h1, h2, k, x) in enumerate(found)), strict=True))
        k = hot[k]
        order = np.argsort(a.at[k] - x, kind="stable")
        single = (h1[order], h2[order], k[order], x[order])
        return cls(a, level, first, single, first_of(*single[:2]))


def _blocks(a: Anchors) -> list[Anchors]:
    return [a.where(np.arange(k, min(k + AT_ONCE, len(a.at)))) for k in range(0, len(a.at), AT_ONCE)]


def _packed(rows: np.ndarray, mask: np.ndarray) -> pa.Array:
    """The symbols under the mask of each row as a binary value: a byte, or the six bytes of a word's hash."""
    flat = rows[mask]
    raw = flat if flat.itemsize == 1 else np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, :6]
    ends = np.r_[0, np.cumsum(mask.sum(axis=1) * (1 if flat.itemsize == 1 else 6))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def _unpacked(hull: pa.Array, left: np.ndarray, right: np.ndarray, m: Method) -> np.ndarray:
    ends = np.frombuffer(hull.buffers()[1], dtype=np.int32)[hull.offset : hull.offset + len(hull) + 1]
    raw = np.frombuffer(hull.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    rows = np.zeros((len(left), m.reach + m.length), dtype=np.uint64 if m.words else np.uint8)
    flat = np.pad(raw.reshape(-1, 6), ((0, 0), (0, 2))).view(np.uint64).ravel() if m.words else raw
    rows[covered(left, right, m)] = flat
    return rows


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    ends = (np.arange(len(values) + 1) * values.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _notes(chunk: np.ndarray, rep: np.ndarray, bits: np.ndarray) -> pa.Table:
    none = pa.nulls(len(chunk), pa.binary())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "gs": none, "level": none, "rep": pa.array(rep, pa.int32()), "bits": _binary(bits)})


def _text_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, str, str]:
    """The texts bucketed by chunk, their bytes, the table's name and its folder."""
    spark = docs.sparkSession
    rows = docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(n, -(-size // TABLE_BYTES)), 100_000)
    chunks = max(4 * n, -(-size // CHUNK_BYTES))
    name = f"strandlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    rows.repartition(n, "chunk").write.bucketBy(n, "chunk").sortBy("chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), size, name, path


def removed(docs: DataFrame, m: Method, id_col: str, text_col: str, hot: int | None = None) -> DataFrame:
    """One row per text, made by the method's ``finish`` from its bytes, its symbols and the mask of those to remove."""
    spark = docs.sparkSession
    texts, size, name, path = _text_table(docs, id_col, text_col)
    made: list[DataFrame] = []
    try:
        return _passes(texts, size, m, HOT if hot is None else hot, made)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(spark, path)
        discard(*made)


def _passes(texts: DataFrame, size: int, m: Method, hot: int, made: list[DataFrame]) -> DataFrame:
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counters, tasks = max(n, -(-size // COUNT_BYTES)), max(n, -(-size // (2 * GROUP_BYTES)))
    groups = 8 * tasks  # several for each task, so that chance doesn't give one task many times its share

    def keys(table: pa.Table) -> pa.Table:
        a = m.anchors(Texts.of(table, m.words))
        gs, at, ns = np.unique(a.g, return_index=True, return_counts=True)
        ps, chunk = a.p[at], table.column("chunk")[0].as_py()
        bucket = ((ps >> np.uint64(20)) % np.uint64(counters)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        gs, ps, ns, bucket = gs[order], ps[order], ns[order].astype(np.uint32), bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(gs)], strict=False))
        own = {"bucket": pa.array(bucket[cut], pa.int32()), "chunk": pa.array([chunk] * len(cut), pa.int32())}
        return pa.table(own | {c: pa.array([v[i:j].tobytes() for i, j in parts], pa.binary()) for c, v in (("gs", gs), ("ps", ps), ("ns", ns))})

    def repeated_keys(table: pa.Table) -> pa.Table:
        """Of each chunk's keys those that occur again, and the level at which their anchors are grouped."""
        gs, ps, ns = ([np.frombuffer(b, dtype=t) for b in table.column(c).to_pylist()] for c, t in (("gs", np.uint64), ("ps", np.uint64), ("ns", np.uint32)))
        all_gs, at, place = np.unique(np.concatenate(gs), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(ns))
        short, of = np.unique(np.concatenate(ps)[at], return_inverse=True)
        crowd = np.bincount(of, weights=np.where(total > 1, total, 0), minlength=len(short))[of]
        level = np.where(total > hot, 2, np.where(crowd > hot, 1, 0)).astype(np.uint8)
        out = []
        for chunk, g in zip(table.column("chunk").to_pylist(), gs, strict=True):
            k = np.searchsorted(all_gs, g)
            k = k[total[k] > 1]
            if len(k):
                out.append((chunk, all_gs[k].tobytes(), level[k].tobytes()))
        c, g, lv = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"chunk": pa.array(c, pa.int32()), "gs": pa.array(g, pa.binary()), "level": pa.array(lv, pa.binary()), "rep": pa.nulls(len(c), pa.int32()), "bits": pa.nulls(len(c), pa.binary())})

    def send(table: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        t = Texts.of(table, m.words) if len(table) and len(notes) else None
        f = Found.of(t, notes, m) if t else None
        if f:
            chunk = table.column("chunk")[0].as_py()

            def rows(rep: np.ndarray, at: np.ndarray, key: np.ndarray, g: np.ndarray, left: np.ndarray, right: np.ndarray, single: bool, hull: pa.Array) -> None:
                row = f.a.row[rep]
                bucket = ((key >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)
                out.append(pa.table({
                    "bucket": bucket, "chunk": pa.array(np.full(len(rep), chunk), pa.int32()), "rep": pa.array(rep, pa.int32()), "single": pa.array(np.full(len(rep), single)),
                    "g": g.view(np.int64), "doc": t.docs[row], "ord": pa.array(t.ords[row], pa.int32()), "at": pa.array(at - t.first[row], pa.int64()),
                    "left": pa.array(left, pa.int32()), "right": pa.array(right, pa.int32()), "hull": hull,
                }))

            own = np.flatnonzero((f.first == np.arange(len(f.first))) & (f.level < 2))
            for k in range(0, len(own), AT_ONCE):
                rep = own[k : k + AT_ONCE]
                b = f.a.where(rep)
                left, right = b.at - b.lo, b.hi + m.length - b.at
                rows(rep, b.at, np.where(f.level[rep] == 0, b.p, b.g), b.g, left, right, False, _packed(around(t.sym, b, m), covered(left, right, m)))
            h1, h2, rep, x = (c[f.first_single == np.arange(len(f.first_single))] for c in f.single)
            if len(rep):
                rows(rep, f.a.at[rep] - x, h1, h1, x, x, True, _binary(h2.view(np.uint8).reshape(-1, 8)))
        return pa.concat_tables(out) if out else _empty(RECORDS)

    def settle(table: pa.Table) -> pa.Table:
        doc, ord_, at = (table.column(c).to_numpy() for c in ("doc", "ord", "at"))
        table = table.take(pa.array(np.lexsort((at, ord_, doc))))
        is_single = table.column("single").to_numpy(zero_copy_only=False).astype(bool)
        out, width = [], -(-(m.reach + 1) // 8)
        s = table.filter(pa.array(is_single))
        if len(s):
            h2 = np.frombuffer(s.column("hull").combine_chunks().take(pa.array(np.arange(len(s)))).buffers()[2], dtype=np.uint64)
            first = first_of(s.column("g").to_numpy(), h2)
            doc = s.column("doc").to_numpy()
            gone = np.flatnonzero(first != np.arange(len(s)) if m.within else doc[first] != doc)
            x = s.column("left").to_numpy()[gone]
            bits = np.zeros((len(gone), 8 * width), dtype=np.uint8)
            bits[np.arange(len(gone)), x] = 1
            out.append(_notes(s.column("chunk").to_numpy()[gone], s.column("rep").to_numpy()[gone], np.packbits(bits, axis=1)))
        c = table.filter(pa.array(~is_single))
        alike = pd.Series(c.column("g").to_numpy()).duplicated(keep=False).to_numpy()
        c = c.filter(pa.array(alike))
        if len(c):
            left, right = c.column("left").to_numpy(), c.column("right").to_numpy()
            hull = c.column("hull").combine_chunks()
            gone = m.resolve(_unpacked(hull, left, right, m), left, right, c.column("doc").to_numpy())
            some = np.flatnonzero(gone.any(axis=1))
            out.append(_notes(c.column("chunk").to_numpy()[some], c.column("rep").to_numpy()[some], np.packbits(np.pad(gone[some], ((0, 0), (0, 8 * width - m.reach - 1))), axis=1)))
        return pa.concat_tables(out) if out else _empty(NOTES)

    def mark(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(table):
            return _empty(m.schema)
        t = Texts.of(table, m.words)
        starts = np.zeros(len(t.sym) + 1, dtype=np.int64)
        f = Found.of(t, notes, m) if len(notes) else None
        if f:
            told = notes.filter(pa.compute.is_valid(notes.column("bits")))
            gone = np.zeros((len(f.first), m.reach + 1), dtype=bool)
            if len(told):
                bits = np.frombuffer(b"".join(told.column("bits").to_pylist()), dtype=np.uint8).reshape(len(told), -1)
                np.logical_or.at(gone, told.column("rep").to_numpy(), np.unpackbits(bits, axis=1)[:, : m.reach + 1].astype(bool))
            _, _, k, x = f.single
            if len(k):
                one = f.first_single
                other = one != np.arange(len(one)) if m.within else f.a.row[k] != f.a.row[k[one]]
                gone[k, x] = other & (t.docs[f.a.row[k]] != t.docs[f.a.row[k[one]]] if not m.within else True) | gone[k[one], x[one]]
            same_id = t.docs[f.a.row] == t.docs[f.a.row[f.first]]
            copy = f.first != np.arange(len(f.first)) if m.within else ~same_id
            for i in range(0, len(f.first), AT_ONCE):
                j = np.arange(i, min(i + AT_ONCE, len(f.first)))
                start = f.a.at[j, None] - np.arange(m.reach + 1)
                own = (start >= f.a.lo[j, None]) & (start <= f.a.hi[j, None])
                starts[start[own & (gone[f.first[j]] | copy[j, None])]] = 1
        ahead = np.r_[0, np.cumsum(starts)]
        place = np.arange(len(t.sym))
        mask = ahead[place + 1] > ahead[np.maximum(place + 1 - m.length, 0)]
        data = t.data.tobytes()
        out = [(int(d), *m.finish(data[a:b], t.sym[i:j], mask[i:j])) for d, a, b, i, j in zip(t.docs, t.byte[:-1], t.byte[1:], t.first[:-1], t.first[1:], strict=True)]
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=_empty(m.schema).schema)

    def kept(df: DataFrame) -> DataFrame:
        made.append(materialize(df))
        return made[-1]

    by_chunk = texts.groupBy("chunk")
    # the number of tasks grows with the data
    repeated = kept(by_chunk.applyInArrow(keys, KEYS).repartition(counters, "bucket").groupBy("bucket").applyInArrow(repeated_keys, NOTES))
    records = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(send, RECORDS)
    verdicts = kept(records.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(settle, NOTES))
    return materialize(by_chunk.cogroup(repeated.unionAll(verdicts).groupBy("chunk")).applyInArrow(mark, m.schema))


_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _empty(schema: str) -> pa.Table:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")]).empty_table()
