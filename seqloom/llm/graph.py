"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (any orderable type, not null). Returns node, component: the smallest node that it reaches; kept in `scratch`.

    Each round takes the smallest label of a label around a node to the node and to the node's own label, so whole regions are
    hooked and not only their borders, and then a node takes the label of its label. Paths of n nodes in random order settle in
    about log2(n) + 2 rounds. Labels only fall and stay within the component, so rounds go on until none changes. Hubs are
    aggregated before the shuffle; lineage is cut in every round, and what a round has replaced is removed.
    """
    edges = edges.where("a <> b")
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        # a join of two scans with one exchange each can be split where a label is hot
        jumps = scratch.keep(labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label").select("node", "label", "jump"))
        around = both.join(jumps.select(F.col("node").alias("b"), "jump"), "b").groupBy("a").agg(F.min("jump").alias("around"))
        near = scratch.keep(jumps.join(around.withColumnRenamed("a", "node"), "node"))
        hooks = near.groupBy("label").agg(F.min("around").alias("hook")).withColumnRenamed("label", "node")
        seen = Observation()
        new = near.join(hooks, "node", "left").select("node", F.least("label", "jump", "around", "hook").alias("new"), "label")
        new = scratch.keep(new.observe(seen, F.count_if(F.col("new") != F.col("label")).alias("changed")).select("node", F.col("new").alias("label")))
        scratch.drop(labels, jumps, near)
        labels = new
        if not seen.get["changed"]:
            scratch.drop(both)
            return labels.withColumnRenamed("label", "component")
