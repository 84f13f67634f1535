"""Mixing sources to target weights by iterative proportional fitting (operator 3, native).

The tokens of each (source, lang, topic) cell are raked until the tokens of
every source, language and topic meet their targets within TOLERANCE, while no
cell takes more than it holds.  A value whose share of the budget is more than
it holds gets what it holds, and the others of its dimension share what that
leaves open by their weights, so all targets of a dimension add up to the
budget.  Raked over held tokens is the probability with which a document of
the cell is drawn; the draw itself is a fixed function of the id and a seed.
``residuals`` compares every target with what is drawn for it.

The cells are an aggregate whose number depends on the distinct values of the
three columns and not on the documents; a table of up to ONE_TASK cells is
raked in one task by window sums without a shuffle, a larger one by shuffles.

Topics are an input like source and language: ``topic_of``, a coarse label of
the text's form, stands in where a table has none.

Defined results: null source, language or topic is a value of its own; a null
or empty text has no tokens and takes its cell's probability (1 in a cell that
has no tokens at all); targets that contradict one another are raked for
MOST_ROUNDS and end with a residual; repeated rows are drawn alike, since they
share an id; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words_of

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its share of the tokens to this power, scaled to one.
TEMPERATURE = 0.7
#: Tokens to draw, of all tokens.
BUDGET = 0.6
#: The largest relative gap to a target, seen to after each step of rounds, and the most rounds.
TOLERANCE, ROUNDS_PER_STEP, MOST_ROUNDS = 1e-3, 6, 120
ONE_TASK = 100_000


def topic_of(text: Column) -> Column:
    """A plain topic label by the form of the text."""
    t = F.coalesce(text, F.lit(""))
    many = lambda c, k: F.length(t) - F.length(F.translate(t, c, "")) > F.length(t) / k
    return F.when(many("|#*$%&", 50), "markup").when(many("!?", 50), "exclaimed").when(many("0123456789", 50), "numeric").otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(cells: DataFrame, dim: str, wanted: Mapping[str, float] | float, budget: float) -> DataFrame:
    """Target tokens of each value of ``dim``: by explicit shares (a value without one gets none) or by a temperature, and no more than it holds."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    values = cells.groupBy(F.col(dim).alias("_v")).agg(F.sum("tokens").alias("held"))
    if isinstance(wanted, Mapping):
        weight = F.lit(0.0)
        for value, x in wanted.items():
            weight = F.when(F.col("_v") == F.lit(value), F.lit(float(x))).otherwise(weight)
    else:
        weight = F.pow(F.col("held") / F.lit(total or 1.0), F.lit(wanted))
    values = values.select("_v", "held", weight.alias("weight"))
    # by held / weight, values are used up one after another; the first that is not sets the level of the rest
    up = W.partitionBy(F.lit(1)).orderBy("ratio", "_v")
    before = F.coalesce(F.sum("held").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    open_ = values.filter("held > 0 and weight > 0").withColumn("ratio", F.col("held") / F.col("weight"))
    open_ = open_.select("*", ((F.lit(budget * total) - before) / rest).alias("level"), F.row_number().over(up).alias("n"))
    level = open_.filter("level <= ratio").agg(F.min_by("level", "n")).first()[0]
    target = F.when((F.col("held") > 0) & (F.col("weight") > 0), F.col("held") if level is None else F.least("held", F.col("weight") * F.lit(level))).otherwise(F.lit(0.0))
    return values.select("_v", target.alias(f"t_{dim}"))


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | float], budget: float = BUDGET) -> DataFrame:
    """``cells`` (the dimensions and tokens) with the target ``t_`` of each value and ``raked``, the tokens to draw from each cell."""
    dims = tuple(wanted)
    few = cells.count() <= ONE_TASK
    table = lambda df: materialize(df.coalesce(1) if few else df)
    c = cells
    for d in dims:
        c = c.join(targets(cells, d, wanted[d], budget), F.col(d).eqNullSafe(F.col("_v"))).drop("_v")
    c = table(c.withColumn("raked", budget * F.col("tokens")))
    for _ in range(0, MOST_ROUNDS, ROUNDS_PER_STEP):
        c = c.coalesce(1) if few else c
        for _ in range(ROUNDS_PER_STEP):
            for d in dims:
                now = F.sum("raked").over(W.partitionBy(d))
                c = c.withColumn("raked", F.when(now > 0, F.least(F.col("tokens"), F.col("raked") * F.col(f"t_{d}") / now)).otherwise(F.lit(0.0)))
        c = table(c)
        gap = residuals(c, dims).filter("target > 0").agg(F.max(F.abs("residual"))).first()[0]
        if (gap or 0.0) <= TOLERANCE:
            break
    return c


def residuals(raked: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """dimension, value, target and drawn tokens, and the relative gap of each value (null for a target of zero)."""
    out = None
    for d in dims:
        one = raked.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum("raked").alias("drawn"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("residual", F.when(F.col("target") > 0, F.col("drawn") / F.col("target") - 1))


def uniform(id_col: str, seed: str = "mix") -> Column:
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def cells_of(rows: DataFrame) -> DataFrame:
    """The tokens of each cell of ``rows`` (the dimensions and n_tokens)."""
    return materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")))


def rates(rows: DataFrame, wanted: Mapping[str, Mapping[str, float] | float] | None = None, budget: float = BUDGET) -> DataFrame:
    """``rows`` (the dimensions and n_tokens) -> the probability ``rate`` of each cell, its dimensions named with a leading underscore."""
    raked = rake(cells_of(rows), wanted or dict.fromkeys(DIMENSIONS, TEMPERATURE), budget)
    rate = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(F.lit(1.0))
    return materialize(raked.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), rate.alias("_rate")))


def _same_cell() -> Column:
    s, l, t = (F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS)
    return s & l & t


def mix(docs: DataFrame, wanted: Mapping[str, Mapping[str, float] | float] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """doc_id, the dimensions, n_tokens, probability and selected for each row of documents."""
    rows = materialize(docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens")))
    return rows.join(rates(rows, wanted, budget), _same_cell()).select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round("_rate", 6).alias("probability"), (uniform("doc_id", seed) < F.col("_rate")).alias("selected")
    )


def sampled(docs: DataFrame, wanted: Mapping[str, Mapping[str, float] | float] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the mix draws."""
    rows = docs.select("source", "lang", topic_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))
    drawn = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"))
    drawn = drawn.join(rates(rows, wanted, budget), _same_cell())
    return drawn.filter(uniform("doc_id", seed) < F.col("_rate")).select("_row.*")
