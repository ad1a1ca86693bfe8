"""Connected components of an edge table, as Spark joins.

Every node points at a node of its component; in each round the nodes and the
nodes they point at are moved to the smallest target seen over their edges
(hooking), and then to their target's target (shortcutting). The number of
rounds grows with the logarithm of the longest path. Every round is a written
table: no growing lineage, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label): label is the smallest node id reachable.

    ``edges`` has long columns a, b (any order, repeats allowed). Nodes
    without an edge do not appear. An empty edge table gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    adj = scratch.save(both.where("a <> b").distinct(), f"{tag}-adj")
    labels = scratch.save(
        adj.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
           .select("node", F.least("node", "m").alias("label")), f"{tag}-0")
    step = 0
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        far = labels.join(up, "label")  # node, label, label of the label
        near = (adj.join(far.select(F.col("node").alias("b"), "top"), "b")
                   .groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near")))
        seen = far.join(near, "node")
        moves = seen.select(F.explode(F.array(
            F.struct("node", F.least("near", "top").alias("label"), F.col("label").alias("old")),
            F.struct(F.col("label").alias("node"), F.least("near", "top").alias("label"),
                     F.lit(None).cast("long").alias("old")))).alias("m")).select("m.*")
        new = moves.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        step += 1
        new = scratch.save(new, f"{tag}-{step}")
        moved = new.where("label <> old").limit(1).count()
        scratch.drop(f"{tag}-{step - 1}")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"{tag}-adj")
            return labels
