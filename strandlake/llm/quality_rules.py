"""Quality rules as a bitmask ledger (operator 9, native).

``ledger`` evaluates every rule once for each document and stores the
measurements and one bit for each failed rule.  Policies are versioned masks
over these bits, so a policy can change, or be compared with another, without
reading a text again; ``ablations`` does that by bitwise aggregation.

Defined results: a null text counts as one without words; ties and repeated
rows are judged alike, row by row; an empty table gives an empty ledger; a
document may be arbitrarily long (every step is linear in its words, or
n log n if it repeats itself).  Columns of the input other than the id and the
text are ignored, so their names cannot clash.  Windows of words and equal
words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

WINDOW = 8

#: (name, condition over the measurements under which a document fails); the place in the list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeat_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_flood", "n_symbols > n_words"),
    ("dup_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeat_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "symbol_flood")), Policy("v2", tuple(BIT)))}
DEFAULT_POLICY = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failure_bits")


def _repeated(grams: Column) -> Column:
    """Words covered by the windows whose hash is in ``grams`` more than once."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(xs: Column) -> Column:
        n = F.size(xs)
        same = lambda x, j: (j >= 0) & (j < n) & (F.get(xs, j)["g"] == x["g"])
        return F.array_sort(F.transform(F.filter(xs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    covered = F.aggregate(
        places(F.col("_ordered")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return ordered, covered


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measurements, and ``failure_bits``."""
    return _measure(docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))).select("_row.*", *MEASURES)


def passing(docs: DataFrame, version: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps; nothing is shuffled."""
    rows = _measure(docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")))
    # a filter would be pushed below the measurements, and evaluate each of them again wherever it is used
    kept = F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")
    return apply_policy(rows, version).select(kept).select("_row.*")


def _measure(d: DataFrame) -> DataFrame:
    """``_row`` and ``_t`` -> ``_row`` with the measurements and bits of the text."""
    d = d.select(
        "_row",
        words_of(F.col("_t")).alias("_w"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^"))).alias("_l"),
    )
    word = F.transform("_w", lambda w: F.xxhash64(w))
    d = d.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        word.alias("_h"),
    )
    gram = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("_h"), i + j) for j in range(WINDOW))))
    d = d.select("*", F.when(F.size("_h") > WINDOW, gram).otherwise(F.array().cast("array<bigint>")).alias("_g"))
    ordered, covered = _repeated(F.col("_g"))
    d = d.select("*", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered).alias("_ordered"))
    d = d.select("*", F.when(F.col("_ordered").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))
    d = d.drop("_h", "_g", "_ordered")
    bits = sum((F.when(F.expr(cond), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, cond in RULES), F.lit(0).cast("long"))
    # the generator keeps filters on the results from being pushed below, where every measurement would be repeated
    measured = d.select("*", bits.alias("failure_bits"))
    return measured.select("_row", F.explode(F.array(F.struct(*MEASURES))).alias("_m")).select("_row", "_m.*")


def apply_policy(rows: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under the policy; the base rules hold in every policy."""
    mask = POLICIES[version].mask | BASE.mask
    return rows.select(
        "*",
        (F.col("failure_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"),
        (F.col("failure_bits").bitwiseAND(F.lit(mask)) == 0).alias("kept"),
        F.lit(version).alias("policy"),
    )


def ablations(rows: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, and rows kept without it.

    The ledger is first counted by bit pattern (at most 2 ** rules patterns).
    """
    mask = POLICIES[version].mask
    patterns = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[version].rules)))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("*", rules.alias("r")).select("bits", "n", "r.*").groupBy("rule")
        .agg(total(fails)("n_failed"), total(F.col("bits") == F.col("bit"))("n_only"), total(rest == 0)("n_kept_without"), F.bit_or("bits").alias("bits_seen"))
    )
