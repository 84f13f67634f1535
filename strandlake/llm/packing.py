"""Best-fit packing after Martello-Toth dominance reduction (operator 6).

Documents become token pieces in the tasks.  What the packing needs to know of
them is how many pieces there are of each length, and lengths end at the
sequence length: this histogram is a bounded table however large the corpus
is.  On it, the reduction fixes sequences that provably dominate every
alternative (a piece with which nothing fits, or that one other piece fills
exactly, or at least as well as any pair could), and best-fit decreasing packs
the rest.  The result is a list of patterns with multiplicities, whose size the
sequence length bounds too (``most_places``); ranks of the pieces within their
length, counted in salted chunks, place every piece.

Defined results: a null text counts as empty; an empty text is a piece of one
token; a text of any length is encoded whole and cut at the sequence length;
repeated rows are packed each on its own; an empty table gives no rows; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_in, id_out, materialize, partitions, per_process

CAPACITY = 2048
#: Words whose ids a worker remembers, and characters of text that it splits at once.
CACHE, CHARS_AT_ONCE = 500_000, 6_000_000

#: Pieces of a chunk that a window ranks.
ROWS_PER_CHUNK = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The steps before the model under which words may be taken apart by the tokenizer's own pattern (fixed values of its format).
_NORMALIZERS, _SPLIT, _SUFFIX = ["NFC", "Replace", "Lowercase"], {"behavior": "Removed", "invert": True}, "</w>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """A mapping that keeps what was used lately: as the young half fills up, it becomes the old half, and the old one goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that have to be added; all others are in the young half after the call."""
        if len(self.young) + len(keys) > self.most:
            self.young, self.old = {}, self.young
        keys = keys.difference(self.young)
        found = [k for k in keys if k in self.old]
        self.young.update((k, self.old[k]) for k in found)
        return list(keys.difference(found))


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, split at ASCII white space: the distinct ones, which word stands at each place, and where each text's words begin."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), words.offsets.to_numpy()


def _joined(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``at``, one after another, and where each word's begin."""
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    return _gather(np.frombuffer(b"".join(ids), dtype="<u4"), np.r_[0, np.cumsum(size)], at)


def _gather(flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[at]
    end = np.r_[0, np.cumsum(n)]
    return flat[np.arange(end[-1]) + np.repeat(first[at] - end[:-1], n)], end


class WordEncoder:
    """Token ids, as little-endian bytes, of texts under a tokenizer that works within white-space-separated words.

    The distinct words of many texts are encoded together, and those seen
    lately are remembered.  Where the tokenizer lower-cases
    and splits words by a pattern, words of Latin-1 letters are taken apart by
    that pattern first, so that a stem is encoded once for all its capitals
    and punctuation; the ids of a part end where a token has the end-of-word
    mark.  (Latin-1 text is its own composed form, so lower case is all that
    normalization changes.)
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Remembered(CACHE), Remembered(CACHE)
        added = self.tokenizer.get_added_tokens_decoder()
        self.parting = max(added.items(), key=lambda x: x[0], default=(None, None))
        self.special = {t.content for t in added.values()}
        self.model, self.pattern = self._part_model(path)
        #: Words that are not taken apart.
        self.odd = "|".join([r"[^\x{00}-\x{ff}]|[\x{1c}-\x{1f}\x{85}\x{a0}A-Z\x{c0}-\x{d6}\x{d8}-\x{de}]", *(re.escape(x) for x in self.special)])

    def _part_model(self, path: str) -> tuple:
        """A tokenizer of ready parts joined by spaces, and the pattern that makes the parts; None for other tokenizers."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers") or []] == _NORMALIZERS
        known = known and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and all(steps[0].get(k) == v for k, v in _SPLIT.items())
        if not known or config["model"].get("end_of_word_suffix") != _SUFFIX or steps[1].get("use_regex") or steps[1].get("add_prefix_space"):
            return None, None
        model = Tokenizer.from_file(path)
        model.normalizer = None
        model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = model.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(_SUFFIX)]] = True
        return model, f"({steps[0]['pattern']['Regex']})"

    def lowered(self, text: str) -> str:
        """The text in lower case where that changes no token."""
        if self.model is None:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(s in low for s in self.special) else low

    def learn_parts(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
            if len(ends) != len(some):
                raise ValueError("the tokenizer has a word without an end mark")
            raw = ids.tobytes()
            self.parts.young.update((p, raw[a:b]) for p, a, b in zip(some, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))

    def learn_words(self, words: list[str]) -> None:
        part_id, part = self.parting[0], str(self.parting[1].content) if self.parting[1] else ""
        alone = [w for w in words if not part or any(x in w for x in self.special)]
        apart = set(alone)
        plain = [w for w in words if w not in apart] if alone else words
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([part.join(some) + part], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == part_id)
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, (4 * ends).tolist(), strict=True):
                self.words.young[w] = raw[a:b]
                a = b + 4
        for w in alone:
            self.words.young[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and where each word's begin."""
        odd = pc.match_substring_regex(words, self.odd).to_numpy(zero_copy_only=False).astype(bool) if self.model is not None else np.ones(len(words), dtype=bool)
        whole, simple = words.filter(pa.array(odd)).to_numpy(zero_copy_only=False).tolist(), words.filter(pa.array(~odd))
        self.learn_words(self.words.missing(set(whole)))
        flat, end = _joined([self.words.young[w] for w in whole], np.arange(len(whole)))
        if not len(simple):
            return flat, end
        parts, at, first = _distinct(pc.replace_substring_regex(simple, self.pattern, r"\1 "))
        parts = parts.to_numpy(zero_copy_only=False).tolist()
        self.parts.young[""] = b""
        self.learn_parts(self.parts.missing(set(parts) - {""}))
        self.parts.young[""] = b""
        simple_flat, simple_end = _joined(list(map(self.parts.young.__getitem__, parts)), at)
        # simple words first, then the whole ones, and both back in the order of ``words``
        ends = np.r_[simple_end[first], simple_end[-1] + end[1:]]
        order = np.empty(len(words), dtype=np.int64)
        order[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(words))
        return _gather(np.r_[simple_flat, flat], ends, order)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        words, at, first = _distinct(pa.array(list(map(self.lowered, texts)), pa.large_string()))
        ids, end = _gather(*self.word_ids(words), at)
        cut = end[first].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield ids[a:b].tobytes()


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of each document: doc_id, piece, start, length, ids_crc32."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_process(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for pdf in batches:
            out, ids, texts = [], pdf.doc_id.to_list(), [t or "" for t in pdf.text]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= CHARS_AT_ONCE):
                    chars += len(texts[to])
                    to += 1
                for doc, x in zip(ids[at:to], encoder.encode(texts[at:to]), strict=True):
                    x += end
                    out += [(doc, k // step, k // 4, min(step, len(x) - k) // 4, zlib.crc32(x[k : k + step])) for k in range(0, len(x), step)]
                at = to
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, PIECES)


#: A pattern: how many sequences have it, and (length, pieces of that length) in their order.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and the counts that are left."""
    left, fixed, lengths = dict(counts), [], sorted(counts)

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del left[s]
            lengths.pop(bisect_left(lengths, s))

    def smallest(k: int, without: int) -> list[int]:
        """The k smallest pieces that are left once one of length ``without`` is taken."""
        out: list[int] = []
        for s in lengths:
            out += [s] * min(k - len(out), left[s] - (s == without))
            if len(out) == k:
                break
        return out

    def best_pair(room: int) -> int:
        """No two pieces within the room have a larger sum than this."""
        return max((s + lengths[k] for s in lengths if (k := bisect_left(lengths, room - s + 1) - 1) >= 0), default=0)

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while s in left:
                room = capacity - s
                k = bisect_left(lengths, room + 1) - 1
                if k >= 0 and lengths[k] == s and left[s] == 1:
                    k -= 1
                if k < 0:
                    n = left[s]
                    fixed.append((n, ((s, 1),)))
                    take(s, n)
                    changed = True
                    break
                t, few = lengths[k], smallest(3, s)
                one_only = len(few) < 2 or few[0] + few[1] > room
                two_only = len(few) < 3 or sum(few) > room
                if not (t == room or one_only or two_only and t >= best_pair(room)):
                    break
                n = left[s] // 2 if s == t else min(left[s], left[t])
                fixed.append((n, ((s, 2),) if s == t else ((s, 1), (t, 1))))
                if s == t:
                    take(s, 2 * n)
                else:
                    take(s, n)
                    take(t, n)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over a histogram: sequences with equal contents move together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, p: Pattern) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(p)

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each = min(capacity // s, n)
                many = n // each
                put(capacity - each * s, (many, ((s, each),)))
                n -= many * each
                continue
            room = rooms[k]
            many, has = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // s, n)
            used = min(many, n // each)
            if many > used:
                put(room, (many - used, has))
            put(room - each * s, (used, (*has, (s, each))))
            n -= used * each
    return [p for ps in open_.values() for p in ps]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Stretches of ranks, in order: columns length, lo, first sequence, pieces a sequence, offset of the first."""
    out: list[tuple[int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    sequence = 0
    for many, content in patterns:
        offset = 0
        for s, each in content:
            out.append((s, taken.get(s, 0), sequence, each, offset))
            taken[s] = taken.get(s, 0) + many * each
            offset += s * each
        sequence += many
    at = np.array(out, dtype=np.int64).reshape(-1, 5)
    return at[np.lexsort((at[:, 1], at[:, 0]))]


def most_places(capacity: int) -> int:
    """A bound on the rows of ``places``, whatever the corpus is.

    The reduction fixes at most two patterns for a length each time one is
    used up; best fit opens at most two patterns for a length and parts at most
    two others.  A sequence holds fewer than sqrt(2 * capacity) + 1 different lengths.
    """
    return 8 * capacity * (math.isqrt(2 * capacity) + 1)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset."""
    rows = materialize(rows)
    spark = rows.sparkSession
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    at = places(plan(histogram, capacity))
    if len(at) > most_places(capacity):
        raise ValueError("the plan is larger than its bound")
    key = at[:, 0] << 40 | at[:, 1]
    chunks = partitions(spark, sum(histogram.values()), ROWS_PER_CHUNK)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    sizes = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    ahead = materialize(sizes.select("length", "chunk", (F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("ahead")))
    ranked = rows.withColumn("rank", (F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "piece")) - 1).cast("long"))
    ranked = ranked.join(ahead, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ahead")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = at[np.searchsorted(key, pdf.length.to_numpy() << 40 | pdf["rank"].to_numpy(), side="right") - 1]
            k = pdf["rank"].to_numpy() - p[:, 1]
            yield pdf.drop(columns="rank").assign(sequence_id=p[:, 2] + k // p[:, 3], offset=p[:, 4] + k % p[:, 3] * pdf.length.to_numpy())

    placed = ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
    return placed.select(id_out("doc_id"), *placed.columns[1:])
