"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b); component is the smallest node reached.

    Each round a node takes the smallest label of its neighbours and then the label of the
    node that its label names, so chains shorten by more than half. Joins run on nodes (of few links
    each) and from many nodes to one label row, which Spark can split; no group is gathered.
    Rounds go through staged tables.
    """
    both = stage(
        links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct()
    )
    labels = stage(
        both.groupBy("node").agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("component"))
    )
    while True:
        near = (
            both.join(labels.toDF("other", "theirs"), "other").groupBy("node")
            .agg(F.min("theirs").alias("theirs"))
        )
        lower = stage(
            labels.join(near, "node")
            .select("node", F.least("component", "theirs").alias("component"), F.col("component").alias("was"))
        )
        if lower.where("component < was").isEmpty():
            return labels
        names = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = stage(lower.join(names, "component").select("node", F.col("next").alias("component")))
