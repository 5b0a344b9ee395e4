"""Connected components of an edge table, by hooking onto smaller neighbours, pointer jumping and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import stage, unstage


def _rooted(hooks: DataFrame) -> DataFrame:
    """hooks(from, to) with each to replaced by the root of its tree: pointers double, so a path of n takes log2(n) joins."""
    while True:
        heads = hooks.select(F.col("from").alias("head"), F.col("to").alias("next"))
        jumped = stage(hooks.join(heads, hooks["to"] == heads["head"], "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "cc-hooks")
        unstage(hooks)
        hooks = jumped
        if hooks.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame, turns: list[int] | None = None) -> DataFrame:
    """node, comp: each node of edges(a, b) with the smallest node it is connected to.

    Each turn hooks every vertex onto its smallest neighbour if that is smaller, follows the hooks to their roots and
    contracts the edges to roots. A turn keeps connectivity, as an edge whose ends moved to different vertices
    remains, and at least halves the vertices that have edges, as every tree has two: turns and jumps are logarithmic
    in the number of nodes, chains included. The smallest node of a component is never hooked, so it is the last root. Labels and edges are
    written between turns. Self-loops and repeated edges have no effect. turns, if given, gets the edges left after each.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
    labels = stage(labels, "cc-labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _rooted(stage(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("from"), "to"), "cc-hooks"))
        old_labels, old_edges = labels, edges
        labels = stage(
            labels.join(hooks, labels["comp"] == hooks["from"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "cc-labels"
        )
        ha = hooks.select(F.col("from").alias("fa"), F.col("to").alias("ta"))
        hb = hooks.select(F.col("from").alias("fb"), F.col("to").alias("tb"))
        moved = edges.join(ha, F.col("a") == F.col("fa"), "left").join(hb, F.col("b") == F.col("fb"), "left")
        edges = stage(
            moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b").distinct(), "cc-edges"
        )
        unstage(old_labels, old_edges, hooks)
        if turns is not None:
            turns.append(edges.count())
    return labels
