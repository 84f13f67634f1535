"""Toxicity by compression distance (operator 5).

Two zstandard dictionaries are trained on labelled text: one on ordinary
windows, one on the beginnings of words that set toxic text apart, within
groups of texts that share their vocabulary (languages, say).  Whole toxic
windows don't serve for the second: most of their words are ordinary, and what
such a dictionary saves by chance drowns what the few toxic words give (README
has the figures).  A text is
cut into windows of a few words; each window is compressed with the ordinary
dictionary alone and with both, so the shorter length shows what only the
toxic dictionary explains.  A logistic model over these gains, fitted on
labelled rows that neither dictionary has seen, turns them into a score.

The fit uses a bounded sample of labelled rows: at most MAX_TOXIC and
MAX_ORDINARY texts of at most MAX_CHARS characters each, those with the
smallest hash of the id, and of the ordinary ones at most MAX_WINDOWS windows
chosen at random.  Scoring reads every whole text.

Defined results: null and empty texts have one empty window and get the score
of no gain; a text of any length is scored whole, window by window; repeated
rows and ties score alike; without labels of either kind every score is the
neutral 0.5; an id with labels of both kinds counts as toxic, and one with a
null label as unlabelled; a null id is kept and counts as held in; an empty
table gives no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, MAX_WINDOWS = 2_000, 4_000, 20_000, 150_000
WORDS, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 12, 3, 32_768, 2_048
#: Bytes of a word's beginning; it needs this share of toxic texts, and this many times the share of ordinary ones.
STEM, FLOOR, LIFT, MOST = (4, 12), 0.02, 20, 0.6
#: Numbers of stems to try; the one that calibrates best is used.
STEMS = (10, 16, 32, 64, 1000)
GAIN, THRESHOLD = 3, 0.7

#: Words that group the texts by vocabulary, and the most groups.
AXES, MOST_GROUPS = 300, 8

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(text: str | None, words: int = WORDS) -> list[bytes]:
    w = (text or "").lower().encode().split()
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)] or [b""]


def _letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def _stems(word: bytes) -> list[bytes]:
    """The beginnings of a word, and the word itself with its end."""
    return [word[:k] for k in range(STEM[0], min(STEM[1], len(word)) + 1)] + [word + b" "]


def vocabulary_groups(texts: list[bytes]) -> np.ndarray:
    """For each text the number of its group; texts of a group share their usual words.

    Words that one text in fifty has are the axes.  Centres start far from one
    another and move to the mean of their texts a few times; a group of under
    one text in a hundred joins the nearest other.
    """
    words = [set(t.split()) for t in texts]
    count = Counter(w for s in words for w in s)
    axes = {w: k for k, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:AXES]) if 50 * n >= len(texts)}
    x = np.zeros((len(texts), len(axes) + 1))
    for k, s in enumerate(words):
        x[k, [axes[w] for w in s & axes.keys()]] = 1
    x[:, -1] = 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    centres = [x[int(np.argmax(x @ mean))]]
    while len(centres) < MOST_GROUPS:
        near = (x @ np.array(centres).T).max(axis=1)
        # the text of the far ones that has the most like it
        far = np.flatnonzero(near <= np.quantile(near, 0.1))
        centres.append(x[far[int(np.argmax((x[far] @ x[far].T).sum(axis=1)))]])
    c = np.array(centres)
    for _ in range(10):
        at = np.argmax(x @ c.T, axis=1)
        c = np.array([x[at == g].mean(axis=0) if (at == g).any() else c[g] for g in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    at = np.argmax(x @ c.T, axis=1)
    large = np.flatnonzero(np.bincount(at, minlength=len(c)) * 100 >= len(texts))
    return np.argmax(x @ c[large].T, axis=1) if len(large) else at


def telling_stems(toxic: list[bytes], ordinary: list[bytes]) -> Counter[bytes]:
    """Beginnings of words that far more toxic than ordinary texts have, with the number of toxic texts."""
    stems = lambda s: {x for w in set(s.split()) for x in _stems(w)}
    a, b = Counter(), Counter()
    for s in toxic:
        a.update(stems(s))
    a = Counter({x: n for x, n in a.items() if n >= max(3, FLOOR * len(toxic))})
    for s in ordinary:
        b.update(stems(s) & a.keys())
    chosen = {x for x, n in a.items() if n * len(ordinary) >= LIFT * (b[x] + 0.5) * len(toxic)}
    # from each shortest stem on, as far as most of its texts go
    out: Counter[bytes] = Counter()
    for x in chosen:
        if not any(x[:k] in chosen for k in range(STEM[0], len(x))):
            while longer := [y for y in a if len(y) == len(x) + 1 and y.startswith(x) and a[y] >= MOST * a[x]]:
                x = max(longer, key=a.get)
            out[x.strip()] = a[x]
    return out


def ranked_stems(toxic: list[bytes], ordinary: list[bytes], group: np.ndarray) -> list[bytes]:
    """The telling stems of all texts and of each group (of toxic, then ordinary), the first of each before the second of any."""
    place: dict[bytes, tuple] = {}
    for g in [None, *np.unique(group).tolist()]:
        a = [t for t, k in zip(toxic, group[: len(toxic)]) if g is None or k == g]
        b = [t for t, k in zip(ordinary, group[len(toxic) :]) if g is None or k == g]
        if a and b:
            counts = telling_stems(a, b)
            for r, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x))):
                place[x] = min(place.get(x, (r, 0, x)), (r, -counts[x], x))
    # what tells in a small group by chance does not tell in all texts
    many = lambda x, texts: sum(b" " + x in t for t in texts)
    real = [x for x in place if many(x, toxic) * len(ordinary) >= LIFT * (many(x, ordinary) + 0.5) * len(toxic)]
    return sorted(real, key=place.get)


#: Ends the tables of a trained dictionary; content follows.
_TABLES_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary that zstandard trains on the samples."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes().partition(_TABLES_END)[2]
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:size]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def gains(self) -> Iterator:
        """A function from a window to the bytes that the toxic dictionary saves."""
        lengths = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            lengths.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        plain, both = lengths
        return lambda w: len(plain(w)) - len(both(w))


def features(gains: list[int]) -> list[float]:
    n = sum(g >= GAIN for g in gains)
    return [1.0, min(max(gains), 10) / 4, np.log1p(n), np.log1p(100 * n / len(gains)) / 2, float(np.clip(np.mean(gains), -1, 1))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _toxic_part(stems: list[bytes]) -> bytes:
    """A dictionary trained on the stems, and the stems as they are, the most usual last."""
    samples = [b" " + b" ".join(stems[k : k + 4]) + b" " for k in range(0, len(stems), 4)]
    part = _trained(TOXIC_BYTES, [s for s in samples for _ in range(8)]) if samples else b""
    part += (b" " + b" ".join(reversed(stems)) + b" ")[-TOXIC_BYTES:]
    # zstandard indexes a dictionary at every third byte first: the ordinary part, which follows, must keep its phase
    return b" " * (-len(part) % 24) + part


def fit(rows: list[tuple[int, str, int]]) -> Model | None:
    """A model from (id, text, toxic): two thirds of the rows train the dictionaries, the rest calibrates."""
    rows = sorted(rows)
    random.Random(7).shuffle(rows)
    train, rest = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if k % 3 == 0]
    toxic, ordinary = ([t for _, t, y in train if y == label] for label in (1, 0))
    if not toxic or not ordinary or len({y for *_, y in rest}) < 2:
        return None
    letters = [[_letters(t) for t in part] for part in (toxic, ordinary, [t for _, t, _ in rest])]
    group = vocabulary_groups([s for part in letters for s in part])
    stems = ranked_stems(*letters[:2], group[: len(toxic) + len(ordinary)])
    plain = [w for t in ordinary for w in windows(t)]
    random.Random(7).shuffle(plain)
    ordinary_part = _trained(ORDINARY_BYTES, plain[:MAX_WINDOWS])
    y = np.array([y for *_, y in rest], dtype=float)
    texts = [windows(t) for _, t, _ in rest]
    # each group with toxic rows weighs as much as any other
    own = group[len(toxic) + len(ordinary) :]
    known = [g for g in np.unique(own) if y[own == g].any()]
    share = sum((own == g) / (own == g).sum() for g in known) / len(known)
    best: tuple[float, Model] | None = None
    for n in dict.fromkeys(min(k, len(stems)) for k in STEMS):
        model = Model(ordinary_part, _toxic_part(stems[:n]), ())
        gain = model.gains()
        x = np.array([features([gain(w) for w in t]) for t in texts])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -float(share @ (y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0]:
            best = loss, Model(model.ordinary, model.toxic, tuple(float(v) for v in w))
    return best[1]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, str, int]]:
    """The bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y"))
    short = docs.filter(~held_out(id_col) & (F.length(text_col) <= MAX_CHARS)).select(F.col(id_col).alias("i"))
    rows = short.join(known, F.col("i") == F.col("_i")).select("i", F.col("_y").alias("y"))
    chosen = [r for label, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)) for r in rows.filter(F.col("y") == label).distinct().orderBy(F.xxhash64("i"), "i").limit(most).collect()]
    # at most MAX_TOXIC + MAX_ORDINARY ids: with them the texts are read in place and not shuffled
    ids = docs.sparkSession.createDataFrame(chosen, "i long, y int")
    texts = docs.filter(F.length(text_col) <= MAX_CHARS).select(F.col(id_col).alias("_i"), F.col(text_col).alias("t"))
    return [(r.i, r.t, r.y) for r in texts.join(F.broadcast(ids), F.col("_i") == F.col("i")).select("i", "t", "y").dropDuplicates(["i", "t"]).collect()]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the largest gain of a window, for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = model.gains() if model else (lambda w: 0)
        weights = np.array(model.weights) if model else np.zeros(5)
        for pdf in batches:
            gains = [[gain(w) for w in windows(t)] for t in pdf.text]
            z = np.array([features(g) for g in gains]).reshape(-1, 5) @ weights
            out = pdf[["doc_id", "held_out"]].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))), max_gain=np.array([max(g) for g in gains], dtype=np.int64))
            yield out.assign(predicted=(out.score >= THRESHOLD).astype("int32"))[["doc_id", "held_out", "score", "predicted", "max_gain"]]

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int, max_gain long")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
