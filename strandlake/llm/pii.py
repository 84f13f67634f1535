"""Personal data by a linear-chain conditional random field (operator 11).

Fixed patterns find the plain forms of e-mail addresses, IP addresses, card
and phone numbers (``base_spans``).  The field adds what they miss: numbers
with other separators, phone numbers without a plus sign, IPv6 addresses,
addresses with letters outside ASCII.

Its words are runs of characters other than ``[\\x20\\x09-\\x0D]``, its
features are shapes: classes of characters, lengths of digit runs, kinds of
neighbours; no letter or digit itself is a feature.  A chain is a stretch of
words of one line within ``REACH`` words of a word that holds a digit, an @ or
a colon pair; the field labels no word outside the chains, so prose costs one pass of
numpy over its bytes.  Chains are cut out of a block of texts at once and
decoded by Viterbi in batches of like length.  A decoded span must pass the
exact check of its kind (``valid``) and not lie within base spans.

The field is trained on a small labelled table (``pii_examples``), on the
driver, in a few seconds; it reads no document.

Defined results: a null text counts as empty and has no spans; texts of any
length are read whole (chains are linear in their words, patterns in their
characters); ties and repeated rows are judged alike, row by row; an empty
table gives an empty result.  Columns other than the id and the text are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_examples
from .pii_examples import luhn

KINDS = ("email", "ip", "card", "phone")
REACH = 2
#: B and I for each kind, then O.
LABELS = tuple(f"{p}-{k}" for k in KINDS for p in "BI")
OUT = len(LABELS)
#: Sizes of the tables of hashed shapes, in bits, and words looked at by one Viterbi batch.
SHAPE_BITS, BATCH_WORDS = 12, 1 << 16
#: Bytes of text in memory at once (a longer text is one block).
BLOCK_BYTES = 4 << 20

# ---- base patterns: a match starts at the first character of its run, so no start is tried twice

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_BACK = re.compile(r"[^A-Za-z0-9._%+-]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: what is before it belongs to no other @."""
    at, free = text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and _BACK.match(text, first - 1) is None:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def octets(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("email", *e) for e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and is_card(_NOT_DIGIT.sub("", m[0]))]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- words and their shapes

#: Classes of bytes: 0 letter, 1 A-Z, 2 digit, then one each; a byte of a longer character counts as a letter.
_CLASS = np.full(256, 10, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91], _CLASS[48:58] = 1, 2
for _c, _chars in enumerate((b"@", b".", b"-_", b"+%", b"()", b":", b"/"), 3):
    _CLASS[list(_chars)] = _c
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CORE = np.zeros(256, bool)
_CORE[[*b"0123456789@"]] = True
CLASSES, DIGITS_UP_TO = 11, 24
#: Punctuation around a word that no span includes.
_LEFT, _RIGHT = "\"'([{<`,;:=!?*#$%&|~", "\"')]}>`.,;:=!?*#$%&|~-"


def word_bounds(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts (bytes one after another, beginning at ``first``) begin and end."""
    space = _SPACE[data]
    edge = np.r_[True, space[:-1]]
    edge[first[:-1][first[:-1] < len(data)]] = True
    begin = np.flatnonzero(~space & edge)
    stop = np.r_[space[1:], True]
    stop[first[1:][first[1:] > 0] - 1] = True
    return begin, np.flatnonzero(~space & stop) + 1


def chains(data: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words within ``REACH`` words of a core word, and the number of each one's chain; no chain crosses a line or a text."""
    core = np.r_[0, np.cumsum(_CORE[data] | ((data == 58) & np.r_[data[1:] == 58, False]), dtype=np.int64)]
    hit = np.flatnonzero(core[end] > core[begin])
    if not len(hit):
        return hit, hit
    line = np.r_[0, np.cumsum(data == 10, dtype=np.int64)][begin] + np.searchsorted(first, begin, side="right")
    near = np.unique((hit[:, None] + np.arange(-REACH, REACH + 1)).ravel())
    near = near[(near >= 0) & (near < len(begin))]
    # of the words near a hit, those on a hit's line
    same = np.zeros(len(near), bool)
    at = np.searchsorted(near, hit)
    for step in range(-REACH, REACH + 1):
        j = at + step
        ok = (j >= 0) & (j < len(near))
        ok[ok] = (near[j[ok]] == hit[ok] + step) & (line[near[j[ok]]] == line[hit[ok]])
        same[j[ok]] = True
    near = near[same]
    new = np.r_[True, (near[1:] != near[:-1] + 1) | (line[near[1:]] != line[near[:-1]])]
    return near, np.cumsum(new) - 1


def _hashed(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each word's row of small numbers."""
    power = np.cumprod(np.full(33, 0x9E3779B97F4A7C15, np.uint64))
    with np.errstate(over="ignore"):
        mixed = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, 32)], starts)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)


#: Features of a word's shape: its hash with and without lengths of digit runs, classes, digits, digit runs, longest digit run,
#: classes inside an address's domain, digits of the stretch of wordless numbers around it; hash and digits of the words beside it; a constant.
_SIZES = (1 << SHAPE_BITS, 1 << SHAPE_BITS, 1 << CLASSES, DIGITS_UP_TO + 1, 9, DIGITS_UP_TO + 1, 4, DIGITS_UP_TO + 2, 1 << SHAPE_BITS, 1 << SHAPE_BITS, DIGITS_UP_TO + 2, DIGITS_UP_TO + 2, 1)
N_FEATURES = sum(_SIZES)
#: The columns that tell shapes exactly; training leaves them out now and then, so that the others learn to do without.
_EXACT = (0, 1, 2, 8, 9)
_TRIM = np.isin(np.arange(256), list(b"\"'([{<`,;:=!?*#$%&|~)]}>."))


def trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to four punctuation marks at either end, one character at least."""
    for _ in range(4):
        begin = begin + ((end - begin > 1) & _TRIM[data[begin]] & (data[begin] != 40))
        end = end - ((end - begin > 1) & _TRIM[data[end - 1]] & (data[end - 1] != 41))
    # a bracket is left only where its other half is in the word or missing
    both = (data[begin] == 40) & (data[end - 1] == 41) & (end - begin > 6)
    return begin + both, end - both


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """(words, features): rows of the weight table that each word of a chain uses."""
    begin, end = trimmed(data, begin, end)
    size = end - begin
    starts = np.cumsum(size) - size
    place = np.repeat(begin - starts, size) + np.arange(size.sum())
    cls, word = _CLASS[data[place]], np.repeat(np.arange(len(begin)), size)
    run = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (word[1:] != word[:-1])])
    length, kind, of = np.diff(np.r_[run, len(cls)]), cls[run], word[run]
    first = np.searchsorted(of, np.arange(len(begin)))
    at = np.arange(len(run)) - first[of]
    exact = _hashed(kind.astype(np.int64) * 8 + np.where(kind == 2, np.minimum(length, 7), 0), first, at)
    coarse = _hashed(kind, first, at)
    mask = np.bitwise_or.reduceat(1 << kind.astype(np.int64), first)
    digit_runs = np.where(kind == 2, length, 0)
    all_digits = np.add.reduceat(digit_runs, first)
    digits = np.minimum(all_digits, DIGITS_UP_TO)
    n_runs, longest = np.minimum(np.add.reduceat(kind == 2, first), 8), np.minimum(np.maximum.reduceat(digit_runs, first), DIGITS_UP_TO)
    ats = np.r_[0, np.cumsum(kind == 3)]
    dot_after = np.add.reduceat((kind == 4) & (ats[1:] > ats[first[of]]), first) > 0
    address = np.minimum(np.add.reduceat(kind == 3, first), 1) + 2 * dot_after
    # words without letters, one after another in a chain, and their digits together
    bare = (mask & 3) == 0
    stretch = np.cumsum(np.r_[True, ~(bare[1:] & bare[:-1] & (chain[1:] == chain[:-1]))]) - 1
    together = np.where(bare, np.minimum(np.bincount(stretch, weights=all_digits).astype(np.int64)[stretch], DIGITS_UP_TO), DIGITS_UP_TO + 1)

    def beside(values: np.ndarray, step: int, none: int) -> np.ndarray:
        out = np.full(len(values), none)
        if step < 0:
            out[1:] = np.where(chain[1:] == chain[:-1], values[:-1], none)
        else:
            out[:-1] = np.where(chain[1:] == chain[:-1], values[1:], none)
        return out

    columns = (
        exact, coarse, mask, digits, n_runs, longest, address, together, beside(coarse, -1, 0), beside(coarse, 1, 0),
        beside(digits, -1, DIGITS_UP_TO + 1), beside(digits, 1, DIGITS_UP_TO + 1), np.zeros(len(begin), np.int64),
    )
    return np.stack(columns, axis=1) + np.cumsum((0, *_SIZES[:-1]))


# ---- the field


@dataclass(frozen=True)
class Field:
    """Weights of features by label, of label pairs, and of first labels."""

    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties: an I follows B or I of its kind only."""
    step, start = np.zeros((OUT + 1, OUT + 1)), np.zeros(OUT + 1)
    for i in range(1, OUT, 2):
        step[:, i], start[i] = -1e4, -1e4
        step[[i - 1, i], i] = 0
    return step, start


def padded(chain: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of chains of like length: (places of the words, which of them exist)."""
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]) if len(chain) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(chain)])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, BATCH_WORDS // int(size[order[at]]))
        ids = order[at : at + n]
        ids = ids[: max(1, int(np.searchsorted(size[ids], 2 * size[ids[0]], side="right")))]
        place = first[ids][:, None] + np.arange(size[ids].max())
        there = np.arange(place.shape[1]) < size[ids][:, None]
        yield np.where(there, place, first[ids][:, None]), there
        at += len(ids)


def viterbi(field: Field, rows: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The best label of each word."""
    emit = field.weight[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        emit = emit + field.weight[rows[:, j]]
    out = np.full(len(rows), OUT)
    for place, there in padded(chain):
        score = emit[place[:, 0]] + field.start
        back = np.zeros((place.shape[1], len(place), OUT + 1), np.int8)
        for t in range(1, place.shape[1]):
            through = score[:, :, None] + field.step
            back[t] = through.argmax(axis=1)
            now = through.max(axis=1) + emit[place[:, t]]
            live = there[:, t, None]
            score, back[t] = np.where(live, now, score), np.where(live, back[t], np.arange(OUT + 1))
        label = score.argmax(axis=1)
        for t in range(place.shape[1] - 1, -1, -1):
            out[place[there[:, t], t]] = label[there[:, t]]
            label = back[t][np.arange(len(label)), label]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Field:
    """Maximum likelihood with a quadratic penalty: forward-backward over all chains at once, adaptive steps.

    The last row of the weights is that of a feature left out.
    """
    rng = np.random.default_rng(seed)
    data, first, points = encoded([t for t, _ in examples])
    begin, end = word_bounds(data, first)
    near, chain = chains(data, first, begin, end)
    begin, end = begin[near], end[near]
    rows, gold = features(data, begin, end, chain), np.full(len(near), OUT)
    text = np.searchsorted(first, begin, side="right") - 1
    for i, (_, spans) in enumerate(examples):
        own = np.flatnonzero(text == i)
        a, b = points[begin[own]] - points[first[i]], points[end[own]] - points[first[i]]
        for kind, lo, hi in spans:
            inside = own[(a < hi) & (b > lo)]
            gold[inside], gold[inside[:1]] = 2 * KINDS.index(kind) + 1, 2 * KINDS.index(kind)
    size = np.bincount(chain)
    start_at = np.cumsum(size) - size
    there = np.arange(size.max()) < size[:, None]
    place = np.where(there, start_at[:, None] + np.arange(size.max()), start_at[:, None])
    step_rule, start_rule = _allowed()
    n = OUT + 1
    weight, step, start = np.zeros((N_FEATURES + 1, n)), np.zeros((n, n)), np.zeros(n)
    params = (weight, step, start)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    one_hot = np.eye(n)
    gold_start = one_hot[gold[start_at]].sum(axis=0)
    follows = chain[1:] == chain[:-1]
    gold_step = np.zeros((n, n))
    np.add.at(gold_step, (gold[:-1][follows], gold[1:][follows]), 1)
    for r in range(1, rounds + 1):
        now_rows = rows.copy()
        for j in _EXACT:
            now_rows[rng.random(len(rows)) < 0.5, j] = N_FEATURES
        emit = weight[now_rows].sum(axis=1)[place]
        rule, begin_rule = step + step_rule, start + start_rule
        t_max = place.shape[1]
        alpha, beta = np.zeros((t_max, len(size), n)), np.zeros((t_max, len(size), n))
        alpha[0] = emit[:, 0] + begin_rule
        for t in range(1, t_max):
            now = _log_sum(alpha[t - 1][:, :, None] + rule, 1) + emit[:, t]
            alpha[t] = np.where(there[:, t, None], now, alpha[t - 1])
        for t in range(t_max - 2, -1, -1):
            back = _log_sum(rule + (emit[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(there[:, t + 1, None], back, beta[t + 1])
        total = _log_sum(alpha[-1], 1)
        share = np.exp(alpha + beta - total[:, None])
        g_emit = np.zeros((len(gold), n))
        pairs = np.zeros((n, n))
        for t in range(t_max):
            live = there[:, t]
            g_emit[place[live, t]] = share[t][live]
            if t:
                pairs += np.exp(alpha[t - 1][live][:, :, None] + rule + (emit[live, t] + beta[t][live])[:, None, :] - total[live][:, None, None]).sum(axis=0)
        g_emit -= one_hot[gold]
        g_weight = np.zeros_like(weight)
        for j in range(rows.shape[1]):
            np.add.at(g_weight, now_rows[:, j], g_emit)
        grads = (g_weight + decay * len(examples) * weight, pairs - gold_step + decay * step, share[0].sum(axis=0) - gold_start + decay * start)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    return Field(weight.astype(np.float32), (step + step_rule).astype(np.float32), (start + start_rule).astype(np.float32))


# ---- spans of texts


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts one after another, where each begins, and the number of code points before each byte."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    first = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
    return data, first, np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]


def core_of(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the punctuation around it."""
    while start < end and text[start] in _LEFT and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while start < end and text[end - 1] in _RIGHT:
        end -= 1
    return start, end


def valid(kind: str, span: str) -> bool:
    """The exact check that a decoded span must pass."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        return is_card(digits) and not any(c.isalpha() for c in span)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() or c in ":@,=" for c in span)
    if kind == "email":
        local, _, domain = span.partition("@")
        return bool(local) and "." in domain.strip(".") and "@" not in domain and not re.search(r"[\s/:()<>\"]", span)
    try:
        ipaddress.ip_address(span)
    except ValueError:
        return False
    return True


def added_spans(field: Field, texts: list[str], known: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text the decoded spans that pass their check and aren't within its known ones."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    data, first, points = encoded(texts)
    if not len(data):
        return out
    begin, end = word_bounds(data, first)
    near, chain = chains(data, first, begin, end)
    if not len(near):
        return out
    begin, end = begin[near], end[near]
    label = viterbi(field, features(data, begin, end, chain), chain)
    heads = np.flatnonzero((label < OUT) & (label % 2 == 0))
    for h in heads.tolist():
        stop = h + 1
        while stop < len(label) and label[stop] == label[h] + 1 and chain[stop] == chain[h]:
            stop += 1
        i = int(np.searchsorted(first, begin[h], side="right")) - 1
        kind, offset = KINDS[label[h] // 2], points[first[i]]
        a, b = core_of(texts[i], int(points[begin[h]] - offset), int(points[end[stop - 1]] - offset))
        if a < b and valid(kind, texts[i][a:b]) and not any(lo <= a and b <= hi for _, lo, hi in known[i]):
            out[i].append((kind, a, b))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many the field added; nothing is shuffled."""
    model = field or train(pii_examples.table())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            base = [base_spans(t) for t in texts]
            added = added_spans(model, texts, base)
            order = lambda s: (s[1], KINDS.index(s[0]), s[2])
            columns = [pa.array(ids, pa.int64()), *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS)]
            columns.append(pa.array([sha256(joined(spans).encode()).hexdigest() for spans in base]))
            columns.append(pa.array([joined(sorted(b + a, key=order)) for b, a in zip(base, added, strict=True)]))
            columns.append(pa.array([len(a) for a in added], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(found, SCHEMA)
