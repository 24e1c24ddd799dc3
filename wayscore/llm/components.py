"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has columns a and b of one orderable type. Each round takes the smallest label among the
    neighbours and then the label of that label, so the rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder; only one number per round comes to the driver.
    """
    one_way = edges.select("a", "b").where("a <> b")
    both = store(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = store(
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near")),
            "near",
        )
        hooked = store(
            labels.join(near, labels["node"] == near["a"], "left").select(
                "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
            ),
            "hooked",
        )
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = store(hooked.join(roots, "label").select("node", "was", F.least("label", "root").alias("label")), "labels")
        moved = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
