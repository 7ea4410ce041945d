"""Connected components of an edge table, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long; component is the smallest node reachable.

    Labels spread along edges and then jump to the label of their label, so that a chain takes a number of rounds
    logarithmic in its length. Each round is written, which cuts the lineage."""
    both = edges.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("to"))
    both = both.unionByName(both.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct()
    both = common.written(both, "cc-edges")
    label = common.written(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "cc-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old"))
        after = common.written(after, "cc-labels")
        changed = not after.where("label <> old").isEmpty()
        common.forget(label)
        label = after
        if not changed:
            break
    return label.select("node", F.col("label").alias("component"))
