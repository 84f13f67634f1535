"""Chat formatting of reply trees (operator 2).

Messages with a parent form trees.  Repeated self-joins enumerate root-to-leaf
paths: each round doubles the distance of the jump pointers and sums the
scores that they pass, so a thread of n messages takes log2(n) rounds, each of
the messages that have not met their root yet.  Leaves are ranked by the sums of their branches; then only the chosen
branches are spelled out, by the pointers of the same rounds, and each is
written as one conversation.

The template writes a turn as ``### role: text</turn>`` and a line end.  In
texts a backslash becomes two, ``###`` becomes ``\\h`` and ``</turn>`` becomes
``\\e``; in roles a colon becomes ``\\c`` too.  The loss spans mark the
assistant texts in the output, in code points.

Defined results: null role or text counts as empty; rows of a conversation
with equal turns are ordered by role and text, repeated ones are all kept; a
null turn comes first; a null conversation is one of its own; a message whose
parent is missing is a root, and messages on a cycle belong to no path; texts
of any length are written whole, a conversation as one row; an empty table
gives no rows; other columns are ignored.  The formatted conversations are the
only table that a call leaves behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

ASSISTANT = "assistant"


def threads(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: tree, node, parent, role, text, score."""
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).cast("long")
    return r.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("long").alias("score")
    )


def climbs(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, total): the scores from each node to its root, summed; and the jump pointers (tree, node, to) of 1, 2, 4 and more steps.

    Nodes that hang from a cycle have no total.  The tables are written; the caller discards them.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    size = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    exists = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    same_tree = F.col("tree").eqNullSafe(F.col("_t"))
    state = materialize(nodes.join(exists, same_tree & (F.col("parent") == F.col("_n")), "left").select("tree", "node", F.col("_n").alias("to"), "score"))
    tables, step = [state], 1
    reached = [state.where("to IS NULL")]  # nodes whose sum is whole; only the others are joined again
    while step < max(2, 2 * size) and not (state := tables[-1].where("to IS NOT NULL")).isEmpty():
        known = reduce(DataFrame.unionAll, [*reached, state])
        far = known.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("score").alias("_s"))
        on = state.join(far, same_tree & (F.col("to") == F.col("_n")))
        tables.append(materialize(on.select("tree", "node", F.col("_to").alias("to"), (F.col("score") + F.col("_s")).alias("score"))))
        reached.append(tables[-1].where("to IS NULL"))
        step *= 2
    return reduce(DataFrame.unionAll, reached).select("tree", "node", F.col("score").alias("total")), tables


def branches(messages: DataFrame, totals: DataFrame, best: int) -> DataFrame:
    """(tree, leaf, score, rank) of the ``best`` leaves of each tree."""
    same = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
    used = messages.select(F.col("tree").alias("_t"), F.col("parent").alias("_n"))
    leaves = totals.join(used, same, "left_anti").select("tree", F.col("node").alias("leaf"), F.col("total").alias("score"))
    return leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= best)


def spelled(leaves: DataFrame, jumps: list[DataFrame], written: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up) for the paths of ``leaves``: ``up`` steps above its leaf stands ``node``.

    Tables that are written on the way are added to ``written``.
    """
    part = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        far = jump.where("to IS NOT NULL").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_to"))
        more = part.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        part = part.unionAll(more.select("tree", "leaf", F.col("_to").alias("node"), (F.col("up") + 2**k).alias("up")))
        if k % 2:  # each round reads the one before twice
            part = materialize(part)
            written.append(part)
    return part


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    def plain(x: Column) -> Column:
        for short, full in (("\\h", "###"), ("\\e", "</turn>"), ("\\c", ":")):
            x = F.replace(x, F.lit(short), F.lit(full))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` paths of each tree by score: tree, leaf, rank, score, formatted, loss_spans (start, length)."""
    messages = materialize(messages)
    totals, jumps = climbs(messages)
    tables = [messages, *jumps]
    try:
        leaves = materialize(branches(messages, totals, best))
        tables.append(leaves)
        return materialize(_formatted(messages, leaves, spelled(leaves, jumps, tables)))
    finally:
        discard(*tables)


def _formatted(messages: DataFrame, leaves: DataFrame, p: DataFrame) -> DataFrame:
    m = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    full = p.join(m, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    turn = F.struct((-F.col("up")).alias("o"), "role", "text")
    whole = full.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chosen = leaves.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "rank", "score")
    ranked = whole.join(chosen, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_l")))
    shaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("### "), escape(t["role"], True), F.lit(": ")).alias("head"), escape(t["text"]).alias("body")))
    ranked = ranked.select("tree", "leaf", "rank", "score", shaped.alias("s"))
    end = "</turn>\n"
    span = "struct<start: bigint, length: bigint>"
    spans = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(end)).cast("long").alias("at"),
            F.when(t["role"] == ASSISTANT, F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))))
            .otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("s", lambda t: F.concat(t["head"], t["body"], F.lit(end))), "")
    return ranked.select("tree", "leaf", "rank", "score", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss`` (the unescaped text under the spans), from the output alone."""
    parts = F.filter(F.split("formatted", "</turn>\n"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit(": ")) + 2)).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", F.transform(parts, turn).alias("turns"), F.array_join(loss, "").alias("loss"))


def summary(formatted: DataFrame) -> DataFrame:
    """The digests of what can be read back from the output."""
    r = read_back(formatted)
    return r.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
