"""Filter interaction audit by windows over a long form (operator 13).

Each document is reduced to a mask of the filters that it fails, and documents
are counted by part and mask: at most 2 ** 5 cells a part.  Each cell is then
unpivoted against the steps of every order of the filters.  A running bit-or
over the steps tells whether an earlier filter has already removed the cell,
conditional sums give the counts of a step, and totals over the window of a
filter give what it removes over all orders.  Only the first pass reads texts;
all later ones read ids, digests and counts.

The filters, of which any failure removes a document:

* A: fewer than 200 words
* B: distinct words are less than half of the words
* C: A-Z are more than 2 % of the code points
* D: any of ``#$%&*|``
* E: the text of a row with a smaller id, in any part, removed or not

Defined results: a null text counts as empty, a null part as the empty string;
a row with a null id fails E never and makes no other row fail it, and has no
label; repeated rows count each, and share their id, so neither makes the other
fail E; of several labels of one id any counts; texts of any length are read
whole; an empty table gives no row.  Texts are equal if their SHA-256 digests
are.  Columns other than the id, the text and the part are ignored, so their
names cannot clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, words_of

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
COUNTS = ("n", "n_good", "n_toxic")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D that it fails."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("doc_id", "part", "_t", words_of(F.col("_t")).alias("_w"))
    words, points = F.size("_w"), F.length("_t")
    holds = lambda chars: points - F.length(F.translate("_t", chars, ""))
    fails = {"A": words < 200, "B": 100 * F.size(F.array_distinct("_w")) < 50 * words, "C": 100 * holds(UPPER) > 2 * points, "D": holds(SYMBOLS) > 0}
    mask = sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), mask.alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all five filters, and counts of documents, good and toxic ones; at most 32 rows a part.

    Rows are first counted by id and text, then by text and part, so that no
    task takes all copies of a text.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    each = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    flagged = lambda c: F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long"))
    each = each.select("doc_id", "part", "digest", "mask", "n", flagged("_good").alias("n_good"), flagged("_toxic").alias("n_toxic"))
    no_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id")
    texts = each.groupBy("digest", "part", "mask").agg(F.min("doc_id").alias("first_id"), no_id, *(F.sum(c).alias(c) for c in COUNTS), *(F.min_by(c, "doc_id").alias(f"{c}_first") for c in COUNTS))
    least = texts.groupBy("digest").agg(F.min("first_id").alias("least_id"))
    both = texts.join(least, "digest")
    fresh = {c: F.when(F.col("first_id") == F.col("least_id"), F.col(f"{c}_first")).otherwise(F.lit(0).cast("long")) for c in COUNTS}
    fresh["n"] = fresh["n"] + F.col("n_no_id")
    kinds = F.array(
        F.struct(F.col("mask").alias("mask"), *(fresh[c].alias(c) for c in COUNTS)),
        F.struct(F.col("mask").bitwiseOR(F.lit(BIT["E"])).alias("mask"), *((F.col(c) - fresh[c]).alias(c) for c in COUNTS)),
    )
    split = both.select("part", F.inline(kinds)).where(F.col("n") > 0)
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def unpivoted(table: DataFrame) -> DataFrame:
    """A row for each cell, order and step: the step's filter, whether the cell fails it, and whether it was removed before."""
    orders = table.select("*", F.explode(F.array(*(F.lit(o) for o in ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in BIT.items() for x in pair)), letter)
    steps = steps.select("*", letter.alias("filter"), bit.alias("_bit"), F.col("mask").bitwiseAND(bit).alias("failed"))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return steps.select("*", F.coalesce(F.bit_or("failed").over(before), F.lit(0)).alias("earlier"))


def audit(table: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included: ``cells`` -> the metrics of the steps."""
    gone, fails = F.col("earlier") != 0, F.col("failed") != 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0).cast("long")))
    metrics: dict[str, Column] = {
        "kept": total(~gone & ~fails), "removed": total(~gone & fails), "redundant": total(gone & fails), "unique_fails": total(F.col("mask") == F.col("_bit")),
        "good_lost": total(~gone & fails, "n_good"), "toxic_lost": total(~gone & fails, "n_toxic"),
    }
    out = unpivoted(table).groupBy("part", "filter_order", "step", "filter").agg(*(c.alias(k) for k, c in metrics.items()))
    return out.select("*", F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The texts are read once: their masks are written, counted into cells, and deleted; the cells are the table that stays."""
    rows = materialize(masks(docs, id_col, text_col, part_col))
    try:
        return audit(materialize(cells(rows, labels)))
    finally:
        discard(rows)
