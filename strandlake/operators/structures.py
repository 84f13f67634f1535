"""The callers of ``nonb`` over many sequences at once: the same hits, found in arrays of letters and counted for each sequence.

The letters of several sequences stand one after another with a separator
before, between and behind them.  No hit has a separator inside: runs, arms and
sums end there, and pairs with one between their arms are left out.

Instead of looking up seeds in a sorted index, the numbers of the k letters at
each place are compared with those some letters further on, one array comparison for
each distance within reach.  Direct repeats of over ``NEAR`` letters' shift have long
arms, so that every ``STEP``-th place is enough for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kmers, nonb

#: What stands between sequences, and how often behind the last one, so that every window of the callers has room.
SEPARATOR, BEHIND = 5, 32
#: Letters that are searched together, and places that are compared at once.
CHUNK, BLOCK = 1 << 18, 1 << 16
#: Shifts of direct repeats up to which every place is compared; arms of those beyond it have at least STEP + 15 letters.
NEAR, STEP = 41, 16

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # where each begins and ends, and its score, arm or unit
_NONE = np.zeros(0, np.int64)
_SIGN = np.array([0, -1, 1, 0, 0, 0], np.int32)


def chunks(column: pa.ChunkedArray | pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A column of sequences in chunks of about ``most`` letters, or one row: (row, base numbers with separators, where each row begins and ends)."""
    text = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    raw = text.cast(pa.large_binary()).fill_null(b"")
    edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    if len(raw) and data[edge[0] : edge[-1]].max(initial=0) >= 0x80:  # one place for each character
        yield from chunks(pa.array([(t or "").encode("ascii", "replace").decode() for t in text.to_pylist()], pa.large_string()), most)
        return
    row = 0
    while row < len(raw):
        to = max(row + 1, int(np.searchsorted(edge, edge[row] + most, "right")) - 1)
        begin = edge[row:to] - edge[row] + np.arange(1, to - row + 1)
        end = begin + np.diff(edge[row : to + 1])
        c = np.full(int(end[-1]) + BEHIND, SEPARATOR, np.uint8)
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            c[a:b] = kmers.LETTERS[data[edge[row + i] : edge[row + i + 1]]]
        yield row, c, begin, end
        row = to


def g4hunter(c: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int = 25, threshold: float = 1.2) -> Hits:
    """As ``nonb.g4hunter_regions``."""
    head = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
    size = np.diff(np.r_[head, len(c)])
    total = np.zeros(len(c) + 1, np.int32)
    np.cumsum(np.repeat(_SIGN[c[head]] * np.minimum(size, 4).astype(np.int32), size), out=total[1:])
    good = np.flatnonzero(np.abs(total[window:] - total[:-window]) >= math.ceil(threshold * window))
    good = good[good + window <= end[np.maximum(np.searchsorted(begin, good, "right") - 1, 0)]]
    good = good[good >= begin[0]]
    if not len(good):
        return _NONE, _NONE, np.zeros(0)
    new = np.flatnonzero(np.r_[True, good[1:] > good[:-1] + window])
    first, last = good[new], good[np.r_[new[1:] - 1, len(good) - 1]] + window
    some = np.flatnonzero(_SIGN[c])
    a = head[np.searchsorted(head, some[np.searchsorted(some, first)], "right") - 1]
    run = np.searchsorted(head, some[np.searchsorted(some, last) - 1], "right") - 1
    b = head[run] + size[run]
    return a, b, (total[b] - total[a]) / (b - a)


def zdna(c: np.ndarray, begin: np.ndarray, end: np.ndarray, minimum: float = 50.0, penalty: float = 3.0) -> Hits:
    """As ``nonb.zdna_regions``."""
    weight = np.zeros(36)
    for step, w in nonb.Z_WEIGHTS.items():
        weight["ACGT".index(step[0]) * 6 + "ACGT".index(step[1])] = w
    w = weight[c[:-1] * np.uint8(6) + c[1:]]
    outer = np.r_[begin - 1, end - 1]  # steps to and from separators
    here = np.arange(len(w), dtype=np.int32)
    last = np.where(w > 0, here, np.int32(-1))
    last[outer] = outer
    place = here - np.maximum.accumulate(last)
    value = np.where(place > 0, -penalty * place, w)
    value[outer] = -float(1 << 20)  # no sum goes on behind it
    total = np.r_[0.0, np.cumsum(value)]
    risen = np.flatnonzero(total[1:] - np.minimum.accumulate(total)[:-1] >= minimum - 0.5)  # a little more than needed; the walk decides
    if not len(risen):
        return _NONE, _NONE, np.zeros(0)
    edge = np.unique(np.r_[begin, end - 1, np.flatnonzero(place == nonb._z_limit(minimum, penalty)) + 1, len(value)])
    out = []
    for part in np.unique(np.searchsorted(edge, risen, side="right") - 1).tolist():
        at = int(edge[part])
        out += [(a + at, b + at, s) for a, b, s in nonb._z_walk(value[at : edge[part + 1]].tolist(), minimum)]
    a, b, s = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(s, float)


def tandem(c: np.ndarray) -> Hits:
    """The STR hits of ``nonb.repeat_regions``."""
    found = []
    for unit in range(1, 10):
        need = max(10, 3 * unit) - unit  # places in a row that are equal to those a unit further on
        same = (c[unit:] == c[:-unit]) & (c[:-unit] < 4)
        have = 1
        while have < need:
            more = min(have, need - have)
            same = same[: len(same) - more] & same[more:]
            have += more
        a = np.flatnonzero(same[1:] > same[:-1]) + 1  # separators are at both ends
        b = np.flatnonzero(same[1:] < same[:-1]) + need + unit
        primitive = np.ones(len(a), bool)
        for v in range(1, unit):
            if unit % v == 0 and len(a):
                own = c[a[:, None] + np.arange(unit)]
                primitive &= (own[:, v:] != own[:, : unit - v]).any(axis=1)
        found.append((a[primitive], b[primitive], np.full(int(primitive.sum()), unit)))
    a, b, unit = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, unit


def _numbers(c: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """The number of the k letters (6 or 10) at each place, or of the same letters read from behind; of bad letters any."""
    c = (c & 3).astype(np.int32)

    def joined(x: np.ndarray, kx: int, y: np.ndarray, ky: int) -> np.ndarray:
        m = min(len(x), len(y) - kx)
        x, y = x[:m], y[kx : kx + m]
        return x | y << 2 * kx if back else x << 2 * ky | y

    c2 = joined(c, 1, c, 1)
    c4 = joined(c2, 2, c2, 2)
    if k == 6:
        return joined(c4, 4, c2, 2)
    return joined(joined(c4, 4, c4, 4), 8, c2, 2)


def _known(c: np.ndarray, k: int) -> np.ndarray:
    """Whether the k letters at each place are bases."""
    good, have = c < 4, 1
    while have < k:
        more = min(have, k - have)
        good = good[: len(good) - more] & good[more:]
        have += more
    return good


def _equal(here: np.ndarray, there: np.ndarray, shifts: range) -> tuple[np.ndarray, np.ndarray]:
    """All (p, p + shift) with equal numbers; ``there`` is longer than ``here`` by the largest shift."""
    at, to = [], []
    same = np.empty(BLOCK, bool)
    for begin in range(0, len(here), BLOCK):
        own = here[begin : begin + BLOCK]
        same[len(own) :] = False
        for s in shifts:
            np.equal(own, there[begin + s : begin + s + len(own)], out=same[: len(own)])
            some = np.flatnonzero(np.packbits(same).view(np.uint64))  # most words of 64 places have no hit
            if len(some):
                word, bit = np.nonzero(same.reshape(-1, 64)[some])
                p = some[word] * 64 + bit + begin
                at.append(p)
                to.append(p + s)
    return (np.concatenate(at), np.concatenate(to)) if at else (_NONE, _NONE)


def _sides(number: np.ndarray, other: np.ndarray, known: np.ndarray, reach: int, kind: type, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers to be compared, those of bad letters unlike any other."""
    here, there = number.astype(kind), np.full(len(other) + reach, top - 1, kind)
    here[~known] = top
    there[: len(other)] = np.where(known, other, top - 1)
    return here, there


def direct(c: np.ndarray, begin: np.ndarray, most_arm: int = 300) -> Hits:
    """The DR hits of ``nonb.bounded_repeats``."""
    known = _known(c, 10)
    number = _numbers(c, 10)
    here, there = _sides(number, number, known, most_arm + 10, np.int32, (1 << 20) + 1)
    p, q = _equal(here, there, range(10, min(NEAR, most_arm + 10) + 1))
    first = (c[p - 1] != c[q - 1]) | (c[p - 1] > 3)
    p, q = p[first], q[first]
    if most_arm + 10 > NEAR:
        some = np.ascontiguousarray(here[::STEP])
        wide = len(some) + (most_arm + 10) // STEP + 1
        cols = np.full(wide * STEP, (1 << 20), np.int32)
        n = min(len(there), len(cols))
        cols[:n] = there[:n]
        cols = np.ascontiguousarray(cols.reshape(wide, STEP).T)
        at, by = [], []
        for s in range(NEAR + 1, most_arm + 11):
            x = np.flatnonzero(some == cols[s % STEP, s // STEP : s // STEP + len(some)])
            if len(x):
                at.append(x * STEP)
                by.append(np.full(len(x), s))
        if at:
            far, shift = np.concatenate(at), np.concatenate(by)
            # to the beginning of the run, unless the place a step before has found it
            back, live = np.zeros(len(far), np.int64), np.arange(len(far))
            for _ in range(STEP):
                x = far[live] - back[live] - 1
                live = live[(x >= 0) & (c[x] == c[x + shift[live]]) & (c[x] < 4)]
                back[live] += 1
            own = back < STEP
            p, q = np.r_[p, (far - back)[own]], np.r_[q, (far - back + shift)[own]]
    arm, shift = np.full(len(p), 10), q - p
    live = np.arange(len(p))
    while len(live):
        live = live[arm[live] < np.minimum(shift[live], most_arm)]
        x = c[p[live] + arm[live]]
        live = live[(x == c[q[live] + arm[live]]) & (x < 4)]
        arm[live] += 1
    good = (shift - arm <= 10) & (np.searchsorted(begin, p, "right") == np.searchsorted(begin, q, "right"))
    return p[good], (q + arm)[good], arm[good]


def facing(c: np.ndarray, begin: np.ndarray, name: str, most_arm: int = 300) -> Hits:
    """The IR or MR hits of ``nonb.bounded_repeats``."""
    least = 6 if name == "IR" else 10
    known = _known(c, least)
    back = _numbers(3 - c if name == "IR" else c, least, True)
    kind, top = (np.uint16, (1 << 12) + 1) if name == "IR" else (np.int32, (1 << 20) + 1)
    p, j = _equal(*_sides(_numbers(c, least), back, known, least + 100, kind, top), range(least, least + 101))
    pair = (lambda i, j: (c[i] + c[j] == 3) & (c[i] < 4) & (c[j] < 4)) if name == "IR" else (lambda i, j: (c[i] == c[j]) & (c[i] < 4))
    i = p + least - 1
    d = j - i
    inner = (d <= 2) | ~pair(i + 1, j - 1)
    inner &= np.searchsorted(begin, i, "right") == np.searchsorted(begin, j, "right")
    i, j, d = i[inner], j[inner], d[inner]
    arm, cap = np.full(len(i), least), (101 + 2 * most_arm - d) // 2 + 1
    live = np.arange(len(i))
    while len(live):
        live = live[arm[live] < cap[live]]
        live = live[pair(i[live] - arm[live], j[live] + arm[live])]
        arm[live] += 1
    return i - arm + 1, j + arm, arm


def hits(c: np.ndarray, begin: np.ndarray, end: np.ndarray, name: str) -> Hits:
    """The hits of one class."""
    if name in ("GQ", "Z_DNA"):
        return (g4hunter if name == "GQ" else zdna)(c, begin, end)
    return tandem(c) if name == "STR" else direct(c, begin) if name == "DR" else facing(c, begin, name)


def tallies(c: np.ndarray, begin: np.ndarray, end: np.ndarray, classes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hits and covered letters of each sequence (rows) and class; overlaps count twice."""
    n = np.zeros((len(begin), len(classes)), np.int64)
    bp = np.zeros_like(n)
    for i, name in enumerate(classes):
        a, b, _ = hits(c, begin, end, name)
        row = np.searchsorted(begin, a, "right") - 1
        n[:, i] = np.bincount(row, minlength=len(begin))
        bp[:, i] = np.bincount(row, weights=b - a, minlength=len(begin)).astype(np.int64)
    return n, bp
