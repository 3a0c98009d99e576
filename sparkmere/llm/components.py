"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALT, Spread, cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b), both long; the component is its least node.

    Each round takes the least label of all neighbours (a partial aggregation) and then the label of the label, so long
    chains halve. Edges of a hub are salted, and so are the many nodes that have one label when they look its label up; no
    key is joined in one task. Rounds are checkpointed; the driver reads a few counts each.
    """
    both = cut(edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    around = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("degree")))
    labels = around.select("node", F.least("node", "least").alias("component"))
    hubs = Spread(around, "node", "degree")
    if hubs.busy is not None:
        both = cut(hubs.salted(both, "a", key="b"))
    else:
        both = both.withColumn(SALT, F.lit(0))
    while True:
        seen = hubs.copied(labels).withColumnRenamed("node", "b")
        near = both.join(seen, ["b", SALT]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now")))
        shared = Spread(lower.groupBy("now").agg(F.count("*").alias("n")), "now", "n")
        target = labels.select(F.col("node").alias("now"), F.col("component").alias("beyond"))
        jumped = cut(shared.join(lower, target, "node", how="left").select("node", "was", F.least("now", "beyond").alias("component")))
        changed = jumped.where("was != component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
