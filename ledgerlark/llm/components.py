"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Each round takes the least label among the neighbours and then follows labels once more,
    so the number of rounds grows with the logarithm of a component's diameter for all but contrived chains.
    Every round is a few shuffles of rows of two longs and is cut by a checkpoint. Null nodes are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = cut(both.select("a", "b").union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("n"))
            .agg(F.min("component").alias("least"))
        )
        lowered = labels.join(near, labels.node == near.n).select(
            "node", F.least("component", "least").alias("component"), F.col("component").alias("was")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("grand"))
        jumped = lowered.join(parents, lowered.component == parents.parent, "left").select(
            "node", F.least("component", F.coalesce("grand", "component")).alias("component"), "was"
        )
        jumped = cut(jumped)
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
