"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of `edges` (a, b); comp is one of the component's nodes.

    Each round points every node at its smallest neighbour, follows the pointers to their
    ends, and merges what points at the same node; edges between merged nodes go. A round
    at least halves the nodes of each component that is left. Rounds are tables in the
    shared folder. Grouping is by aggregates only, which shrink a hot node before the
    shuffle; joins on a hot node are ones that adaptive execution can split.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    label = stored(nodes.select("node", F.col("node").alias("comp")), "cc-nodes")
    while not left.isEmpty():
        both = left.select(F.col("a").alias("at"), F.col("b").alias("to")).union(left.select("b", "a"))
        up = stored(both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("up")), "cc-up")
        while True:
            nxt = up.select(F.col("at").alias("up"), F.col("up").alias("upper"))
            jumped = stored(up.join(nxt, "up").select("at", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "cc-jump")
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        merged = left.join(up.select(F.col("at").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("at").alias("b"), F.col("up").alias("ub")), "b")
        left = stored(merged.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-edges")
        moved = label.join(up.select(F.col("at").alias("comp"), "up"), "comp", "left")
        label = stored(moved.select("node", F.coalesce("up", "comp").alias("comp")), "cc-nodes")
    return label
