"""Connected components of a graph too large for any one machine, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): each node's smallest reachable node.

    Every round points each node to its smallest neighbour, follows the
    pointers to their ends, and contracts the graph to those ends.  Half of the
    nodes go in each round, so the rounds grow with the logarithm of the graph.
    Grouped minima combine before the shuffle, and both sides of every join are
    tables, so a node with very many edges can be split.
    """
    e = materialize(edges.filter("a != b").select("a", "b"))
    labels = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            ends = point.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            nearer = materialize(point.join(ends, "root").select("node", F.col("root").alias("_was"), F.col("_next").alias("root")))
            moved = not nearer.filter("_was != root").isEmpty()
            point = nearer.drop("_was")
            if not moved:
                break
        if labels is None:
            labels = point
        else:
            to = point.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            labels = materialize(labels.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
        pa, pb = point.select(F.col("node").alias("a"), F.col("root").alias("ra")), point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialize(e.join(pa, "a").select("ra", "b"))
        e_next = left.join(pb, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e_next = materialize(e_next)
        discard(e, left)
        e = e_next
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
