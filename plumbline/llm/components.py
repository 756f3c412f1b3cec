"""Connected components by the smallest label, with pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored


def contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, fewer where nodes share several smaller neighbours: each node and its smaller neighbours link to the smallest of these."""
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    e = e.withColumn("m", F.min("a").over(W.partitionBy("b")))
    return e.select("m", "b").union(e.where("a != m").select("m", "a")).toDF("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node reachable) for the nodes of ``links`` (``a``, ``b``: long, null-free).

    Each round takes the smallest label among neighbours and then the label of that label, so chains shorten by half;
    links are contracted first, and a node's many links pre-aggregated before the shuffle. Rounds are written to the
    shared folder.
    """
    links = stored(contracted(stored(contracted(links), "links")), "links")
    both = stored(links.union(links.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        two = stored(one.join(jump, F.col("new") == F.col("__n")).select("node", F.least("new", "__l").alias("label"), "old"), "labels")
        changed = two.where("label != old").limit(1).count()
        labels = two.select("node", "label")
        if not changed:
            return labels
