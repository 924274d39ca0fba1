"""Connected components of an edge table by min-label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, to): each node points to its smallest neighbour, or itself."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    return both.groupBy("node").agg(F.min("to").alias("to")).select(
        "node", F.least("node", "to").alias("to"))


def _jumped(p: DataFrame) -> DataFrame:
    """One pointer jump: a node's target is replaced by its target's target."""
    q = p.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return p.join(q, "to", "left").select("node", F.coalesce("next", "to").alias("to"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b); the label is
    the smallest node of the component.

    A round points each node to its smallest neighbour, follows the pointers
    to their ends, and replaces the ends of each edge by these; edges within a
    group vanish, so their number falls by rounds.  Labels and edges are
    checkpointed in each round.  Loops and repeated edges are allowed; an
    empty table gives an empty result."""
    edges = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    labels = None
    while not edges.isEmpty():
        p = _pointers(edges).checkpoint()
        while True:
            nxt = _jumped(p).checkpoint()
            moved = not nxt.join(p.withColumnRenamed("to", "old"), "node").filter(
                "to <> old").isEmpty()
            p = nxt
            if not moved:
                break
        step = p.select(F.col("node").alias("label"), F.col("to"))
        if labels is None:
            labels = p.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(step, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")).checkpoint()
        ends = p.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        edges = edges.join(ends, "a").join(
            ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = edges.filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = edges.distinct().checkpoint()
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
