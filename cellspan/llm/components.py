"""Connected components of links that tasks have already contracted, without a hot key and without the driver.

Input rows say that a node belongs to a local group and what the smallest node of that group is.  A round gives each group the smallest
label of its members and each node the smallest of its groups, then follows labels of labels (pointer jumping), so that
chains shorten fast.  Rounds end when no label changes.  Every table is written, so that a round's plan never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import materialise


def components(members: DataFrame) -> DataFrame:
    """``(node, component)`` from ``(node, local, least)``: the smallest node that is reachable; only nodes in ``members`` appear."""
    members = materialise(members.select("node", "local", "least"), "members")
    labels = materialise(members.groupBy("node").agg(F.min(F.least("least", "node")).alias("label")), "labels")
    members = members.select("node", "local")
    while True:
        of_local = materialise(
            members.join(labels, "node").groupBy("local").agg(F.min("label").alias("least")), "local-labels"
        )
        nearer = materialise(
            members.join(of_local, "local").groupBy("node").agg(F.min("least").alias("label")), "labels"
        )
        # A label is a node itself, mostly one with a smaller label of its own.
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = materialise(
            nearer.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        changed = jumped.withColumnRenamed("label", "new").join(labels, "node").where(F.col("new") != F.col("label")).limit(1).count()
        labels = jumped
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
