"""k-mer counting by super-k-mers: runs of letters are shuffled, not k-mers.

A k-mer goes to the part that its minimizer (the least hash of its m-mers, the
same on both strands) decides, so all its occurrences meet in one task.
Neighbouring k-mers mostly share a minimizer; a run of them is sent as letters,
two bits each, and one byte for its length.  A group (a genome, a pair) of up
to ``PART_LETTERS`` letters is a single part and its runs are whole stretches
of bases; a larger one is split into as many parts as it needs.  Tasks count in
numpy, group after group as sorted rows come in, and hold the counts of one
part and one batch of letters, not the letters of a part.

One count gives spectra (``spectra``), pairs (``joint_spectrum``: matrices,
shared and missing k-mers, spectra of both sides) and plain counts (``counts``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmers

#: Letters of a group in one part, and of a run.
PART_LETTERS, RUN_LETTERS = 8 << 20, 255
#: Groups of more than one part that are sent to every task; beyond that they are joined by a shuffle.
MOST_LARGE = 100_000


def minimizer_hash(base: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each k-mer the least hash of its m-mers, read on either strand; places with other letters are meaningless."""
    n = len(base) - m + 1
    low = (base & 3).astype(np.uint64)
    forward, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(m):
        forward = forward << np.uint64(2) | low[j : j + n]
        back |= (np.uint64(3) - low[j : j + n]) << np.uint64(2 * j)
    with np.errstate(over="ignore"):
        h = (np.minimum(forward, back) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    out = h[: len(base) - k + 1].copy()
    for j in range(1, k - m + 1):
        np.minimum(out, h[j : j + len(out)], out=out)
    return out


def minimizer_length(k: int, parts: int) -> int:
    """Short, for long runs, but with many more minimizers than parts, and at most about half of k."""
    return max(1, min((k + 1) // 2, 2 + math.ceil(math.log(max(parts, 4), 4))))


def runs(base: np.ndarray, first: np.ndarray, parts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of rows of letters: (row, part, start, letters); ``parts`` has the number of parts of each row."""
    n = len(base) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    other = np.r_[0, np.cumsum(base == 4)]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    at = np.flatnonzero((other[k:] == other[:-k]) & (np.arange(n) + k <= first[row + 1]))
    if not len(at):
        return none, none, none, none
    row = row[at]
    if parts.max(initial=1) > 1:
        part = (minimizer_hash(base, k, m)[at] % parts[row].astype(np.uint64)).astype(np.int64)
    else:
        part = np.zeros(len(at), np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[new, len(at)])
    most = RUN_LETTERS - k + 1
    pieces = -(-size // most)
    of = np.repeat(np.arange(len(new)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = new[of] + nth * most
    letters = np.minimum(size[of] - nth * most, most) + k - 1
    return row[start], part[start], at[start], letters


def packed(base: np.ndarray, start: np.ndarray, letters: np.ndarray, owner: np.ndarray, owners: int) -> tuple[pa.Array, pa.Array]:
    """For each owner of runs (sorted by owner) its letters, four in a byte, and a byte for the length of each run."""
    total = np.bincount(owner, weights=letters, minlength=owners).astype(np.int64)
    room = -(-total // 4) * 4
    before = np.cumsum(letters) - letters
    shift = (np.cumsum(room) - room) - (np.cumsum(total) - total)
    place = np.repeat(start - before, letters) + np.arange(letters.sum())
    out = np.zeros(int(room.sum()), np.uint8)
    out[np.arange(len(place)) + np.repeat(shift[owner], letters)] = base[place]
    four = out.reshape(-1, 4)
    data = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    binary = lambda size, buffer: pa.Array.from_buffers(pa.binary(), owners, [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buffer))])
    return binary(room // 4, data), binary(np.bincount(owner, minlength=owners), letters.astype(np.uint8))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed letters in slices of about as many letters as a piece."""
    for batch in batches:
        letters = np.cumsum(pc.binary_length(batch.column("_letters")).to_numpy().astype(np.int64) * 4)
        row = 0
        while row < batch.num_rows:
            before = letters[row - 1] if row else 0
            to = max(row + 1, int(np.searchsorted(letters, before + kmers.PIECE_LETTERS, "right")))
            yield batch.slice(row, to - row)
            row = to


def unpacked(data: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, where each run begins, and the row of each run."""

    def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]], np.diff(edge)

    four, n_bytes = parts(data)
    letters, n_runs = parts(sizes)
    letters = letters.astype(np.int64)
    row = np.repeat(np.arange(len(n_runs)), n_runs)
    base = np.stack([four & 3, four >> 2 & 3, four >> 4 & 3, four >> 6], axis=1).ravel()
    total = np.bincount(row, weights=letters, minlength=len(n_runs)).astype(np.int64)
    # the letters that fill the last byte of a row are left out
    keep = np.arange(len(base)) - np.repeat(np.cumsum(n_bytes * 4) - n_bytes * 4, n_bytes * 4) < np.repeat(total, n_bytes * 4)
    return base[keep], np.r_[0, np.cumsum(letters)], row


def split(seqs: DataFrame, k: int, *by: str, seq: str = "seq", part_letters: int = PART_LETTERS, size_by: tuple[str, ...] | None = None, lettered: kmers.Lettered | None = None) -> DataFrame:
    """(by, _part, _letters, _runs): the super-k-mers of each sequence, one row for each part that it has k-mers in.

    ``size_by`` are the columns whose groups are split alike, if not ``by``;
    ``lettered`` makes sequences of the texts in ``seq``.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be within 1..31")
    group = by if size_by is None else size_by
    rows = seqs.select(*(F.col(c) for c in by), F.col(seq).alias("_s"))
    size = rows.groupBy(*group).agg(F.sum(F.length("_s")).alias("_size"))
    large = size.where(F.col("_size") > part_letters).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.ceil(F.col("_size") / part_letters).alias("_parts"))
    n_large = large.limit(MOST_LARGE + 1).count()
    m = minimizer_length(k, (large.agg(F.max("_parts")).first()[0] if n_large else None) or 1)
    if not n_large:
        rows = rows.withColumn("_parts", F.lit(1).cast("long"))
    elif not group:
        rows = rows.withColumn("_parts", F.lit(large.first()["_parts"]).cast("long"))
    else:
        large = F.broadcast(large) if n_large <= MOST_LARGE else large
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
        rows = rows.join(large, same, "left").select(*by, "_s", F.coalesce("_parts", F.lit(1).cast("long")).alias("_parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kmers.few(batches, "_s", lettered):
            parts = batch.column("_parts").to_numpy()
            for begin, _, _, base, first in kmers.pieces(batch.column("_s"), k - 1):
                row, part, start, letters = runs(base, first, parts[begin : begin + len(first) - 1], k, m)
                if not len(row):
                    continue
                order = np.lexsort((part, row))
                row, part, start, letters = row[order], part[order], start[order], letters[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]
                owner = np.cumsum(new) - 1
                data, sizes = packed(base, start, letters, owner, int(owner[-1]) + 1)
                at = pa.array(begin + row[new])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in by), pa.array(part[new]), data, sizes], names=[*by, "_part", "_letters", "_runs"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by]
    return rows.mapInArrow(cut, ", ".join([*kinds, "_part long", "_letters binary", "_runs binary"]))


Table = tuple[np.ndarray, np.ndarray, np.ndarray]  # codes, and their numbers on the first and on the second side


def _merged(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> Table:
    """The sums for each code."""
    order = np.argsort(code, kind="stable")
    code, a, b = code[order], a[order], b[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return (code[new], np.add.reduceat(a, new), np.add.reduceat(b, new)) if len(code) else (code, a, b)


def tallied(cut: DataFrame, k: int, by: tuple[str, ...], schema: str, emit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], canonical: bool, second: str | None = None, partitions: int | None = None) -> DataFrame:
    """Counts of each (by, _part), given to ``emit`` as (group, code, n on the first side, n on the second), groups ascending.

    ``second`` names a boolean column that tells the sides apart.  ``emit``
    returns the group of each result row and its columns.
    """
    keys = [*by, "_part"]
    n = partitions or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(n, *keys).sortWithinPartitions(*keys)
    types = [f for f in cut.schema.fields if f.name in keys]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_table = None, None

        def rows_of(key_rows: pa.RecordBatch, group: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            of, columns = emit(group, code, a, b)
            at = pa.array(of)
            return pa.RecordBatch.from_arrays([*(key_rows.column(c).take(at) for c in keys), *(pa.array(c) for c in columns)], names=[*keys, *names])

        names = [part.split()[0] for part in schema.split(", ")]
        for batch in _sliced(batches):
            base, first, run_row = unpacked(batch.column("_letters"), batch.column("_runs"))
            code, run = kmers.codes(base, first, k, canonical)
            key = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            new = np.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            of = group[run_row[run]]
            side = np.asarray(batch.column(second).to_numpy(zero_copy_only=False), bool)[run_row[run]] if second else np.zeros(len(code), bool)
            order = np.lexsort((code, of))
            code, of, side = code[order], of[order], side[order]
            head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])]) if len(code) else np.zeros(0, np.int64)
            b = np.add.reduceat(side.astype(np.int64), head) if len(code) else head
            a = np.diff(np.r_[head, len(code)]) - b
            code, of = code[head], of[head]
            key_rows = batch.select(keys).take(pa.array(heads))
            # a group that the last batch left open goes on, or is done
            if open_key is not None:
                if key[0] == open_key[0]:
                    mine = of == 0
                    table = _merged(*(np.r_[x, y[mine]] for x, y in zip(open_table, (code, a, b), strict=True)))
                    code, a, b, of = (np.r_[x, y[~mine]] for x, y in zip((*table, np.zeros(len(table[0]), np.int64)), (code, a, b, of), strict=True))
                else:
                    yield rows_of(open_key[1], np.zeros(len(open_table[0]), np.int64), *open_table)
            last = of == len(heads) - 1
            open_key, open_table = (key[-1], key_rows.slice(len(heads) - 1)), (code[last], a[last], b[last])
            yield rows_of(key_rows, of[~last], code[~last], a[~last], b[~last])
        if open_key is not None:
            yield rows_of(open_key[1], np.zeros(len(open_table[0]), np.int64), *open_table)

    return dealt.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in types), schema]))


def _plain(group: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    return group, [code, a + b]


def _histogram(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a, group))
    group, a, b = group[order], a[order], b[order]
    head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(group) else np.zeros(0, np.int64)
    return group[head], a[head], b[head], np.diff(np.r_[head, len(group)])


def counts(seqs: DataFrame, k: int, *by: str, seq: str = "seq", canonical: bool = False, part_letters: int = PART_LETTERS, lettered: kmers.Lettered | None = None) -> DataFrame:
    """(by, code, n) of all k-mers; every k-mer is counted in one task, so nothing is grouped again."""
    out = tallied(split(seqs, k, *by, seq=seq, part_letters=part_letters, lettered=lettered), k, by, "code long, n long", _plain, canonical)
    return out.select(*by, "code", "n")


def spectra(seqs: DataFrame, k: int, *by: str, seq: str = "seq", canonical: bool = False, part_letters: int = PART_LETTERS, lettered: kmers.Lettered | None = None) -> DataFrame:
    """(by, x, n_x): how many k-mers occur x times; only these small rows leave the counting task."""

    def emit(group: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        of, x, _, n = _histogram(group, a + b, np.zeros(len(a), np.int64))
        return of, [x, n]

    out = tallied(split(seqs, k, *by, seq=seq, part_letters=part_letters, lettered=lettered), k, by, "x long, n_x long", emit, canonical)
    return out.groupBy(*by, "x").agg(F.sum("n_x").alias("n_x"))


def joint_spectrum(seqs: DataFrame, k: int, pair: str = "pair_id", side: str = "which", seq: str = "seq", canonical: bool = False, part_letters: int = PART_LETTERS, lettered: kmers.Lettered | None = None) -> DataFrame:
    """(pair, orig, syn, n): how many k-mers a pair has ``orig`` times on one side and ``syn`` times on the other.

    The letters of both sides meet in one task; what leaves it is a histogram.
    """
    keyed = seqs.select(pair, (F.col(side) != "orig").alias("_second"), F.col(seq).alias("seq"))

    def emit(group: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        of, x, y, n = _histogram(group, a, b)
        return of, [x, y, n]

    cut = split(keyed, k, pair, "_second", part_letters=part_letters, size_by=(pair,), lettered=lettered)
    out = tallied(cut, k, (pair,), "orig long, syn long, n long", emit, canonical, second="_second")
    return out.groupBy(pair, "orig", "syn").agg(F.sum("n").alias("n"))


def both_spectra(joint: DataFrame, k: int, pair: str = "pair_id") -> DataFrame:
    """The spectra of both sides: (pair, which, x, n_x, pmf)."""
    sides = F.array(F.struct(F.lit("orig").alias("which"), F.col("orig").alias("x")), F.struct(F.lit("syn").alias("which"), F.col("syn").alias("x")))
    long = joint.select(pair, F.inline(sides), "n").where(F.col("x") > 0)
    return long.groupBy(pair, "which", "x").agg(F.sum("n").alias("n_x")).withColumn("pmf", F.col("n_x") / F.lit(float(4**k)))
