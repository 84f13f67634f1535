"""Near copies by exact Jaccard similarity of word shingles (the pipeline's near-dedup stage).

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  SimHash bits alone can't index that: such texts
differ in up to 17 of 64 bits, and every block of bits that they are sure to
share is too short for a shuffle key.  So the keys are bands of minima of
hashed shingles.  Texts with a band in common and fingerprints within
SIMHASH_BITS are candidates, and a task keeps only a forest of these links.
The components of the forest are then checked by the shingle sets themselves,
so no link below 0.8 is left.

A pair at exactly 0.8 has no band in common with probability
(1 - 0.8^6)^32 = 6e-5, and fewer at higher similarity.

A key or component that very many texts share is dealt to pairs of chunks, so
that no task takes it whole.

Defined results: lower-cased words count; a text of fewer words than a shingle
has one shingle; texts without words are alike; null counts as empty; equal
texts are one node, known by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_in, id_out, materialize, partitions
from .components import connected_components
from .simhash import _union, folded, shingle_hashes, trie_forest

SHINGLE, SIMILARITY, SIMHASH_BITS = 5, 0.8, 24
BANDS, BAND_ROWS = 32, 6
#: Rows of one task's group of paths and of texts, and members of a key and of a component beyond which it is dealt to chunks.
PATHS_PER_GROUP, TEXTS_PER_GROUP, HOT_KEY, HOT_COMPONENT = 100_000, 500, 4_000, 400

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)[:, None]
_ODD = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] | np.uint64(1)
_FOLD = _RNG.integers(0, 2**64, BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def node_of(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def bands(h: np.ndarray) -> np.ndarray:
    """The keys of the bands of a set of shingle hashes."""
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(h), 4096):
        x = (h[None, k : k + 4096] ^ _XOR) * _ODD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
    x = (low.reshape(BANDS, BAND_ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h = [shingle_hashes(t, SHINGLE) for t in pdf.text]
        fp = np.array([folded(x) for x in h], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf.doc_id, "node": pdf.node, "fp": fp, "bands": [bands(x) for x in h]})


def _dealt(table: DataFrame, by: list[str], hot: int) -> DataFrame:
    """``table`` with ``chunk``: 0, or for keys of more than ``hot`` rows each pair of chunks that a row's own is in."""
    many = materialize(table.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*by, F.ceil(2 * F.col("n") / hot).cast("int").alias("chunks")))
    if many.isEmpty():
        return table.withColumn("chunk", F.lit(0))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own) + 1)
    return table.join(many, by, "left").withColumn("chunk", F.explode(F.coalesce(pairs, F.array(F.lit(0))))).drop("chunks")


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    fp = pdf.fp.to_numpy().view(np.uint64)
    group = pd.factorize(pd.MultiIndex.from_arrays([pdf.t, pdf.key, pdf.chunk]))[0]
    order = np.lexsort((fp, group))
    label = trie_forest(fp[order], group[order], budget=SIMHASH_BITS)
    own = pdf.node.to_numpy()[order]
    linked = label != np.arange(len(label))
    return pd.DataFrame({"a": own[linked], "b": own[label[linked]]}).drop_duplicates()


def similar_forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Labels of the components of sets (distinct values each) with a Jaccard similarity of at least ``similarity``."""
    n, label = len(sets), np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    codes = pd.factorize(np.concatenate(sets))[0]
    start = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(codes) + 1, dtype=bool)
    rest = np.arange(n)
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        fits = (size[rest] >= similarity * size[i]) & (size[i] >= similarity * size[rest])
        at = rest[fits]
        mark[codes[start[i] : start[i + 1]]] = True
        both = np.array([mark[codes[start[j] : start[j + 1]]].sum() for j in at], dtype=np.int64)
        mark[codes[start[i] : start[i + 1]]] = False
        found = at[both >= similarity * (size[i] + size[at] - both) - 1e-9]
        if len(found):
            label = _union(label, found, np.full(len(found), i))
            queue += found.tolist()
            rest = rest[~np.isin(rest, found)]
    return label


def _checked(pdf: pd.DataFrame) -> pd.DataFrame:
    out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for _, g in pdf.groupby(["root", "chunk"]):
        own = g.node.to_numpy()
        # a text without words has one shingle of its own
        sets = [np.unique(h) if len(h := shingle_hashes(t, SHINGLE)) else np.zeros(1, dtype=np.uint64) for t in g.text]
        label = similar_forest(sets)
        linked = label != np.arange(len(label))
        out.append(pd.DataFrame({"a": own[linked], "b": own[label[linked]]}))
    return pd.concat(out)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (of the text), component and keep_id, keep_node (the component's smallest id and its node) for each row."""
    spark = docs.sparkSession
    texts = docs.select(id_in(id_col).alias("doc_id"), node_of(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(texts.mapInPandas(_sketches, "doc_id long, node long, fp long, bands array<long>"))
    nodes = rows.select("node", "fp", "bands").dropDuplicates(["node"])
    paths = materialize(nodes.select("node", "fp", F.posexplode("bands").alias("t", "key")))
    shared = paths.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    paths_shared = materialize(paths.join(shared, ["t", "key"], "left_semi"))
    discard(paths)
    groups = partitions(spark, paths_shared.count(), PATHS_PER_GROUP)
    group = F.pmod(F.xxhash64("t", "key", "chunk"), F.lit(groups)).cast("int")
    likely = connected_components(_dealt(paths_shared, ["t", "key"], HOT_KEY).groupBy(group.alias("g")).applyInPandas(_candidates, "a long, b long"))
    members = materialize(_dealt(likely, ["root"], HOT_COMPONENT).select("node", "root", "chunk"))
    groups = partitions(spark, members.count(), TEXTS_PER_GROUP)
    group = F.pmod(F.xxhash64("root", "chunk"), F.lit(groups)).cast("int")
    known = texts.select("node", "text").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    checked = known.join(members, "node").groupBy(group.alias("g")).applyInPandas(_checked, "a long, b long")
    roots = connected_components(checked).select(F.col("node").alias("_n"), "root")
    found = materialize(rows.select("doc_id", "node").join(roots, F.col("node") == F.col("_n"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("component")))
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("w")).select("component", F.col("w.doc_id").alias("keep_id"), F.col("w.node").alias("keep_node"))
    discard(paths_shared, rows)
    return found.join(best, "component").select(id_out("doc_id"), "node", "component", id_out("keep_id"), "keep_node")
