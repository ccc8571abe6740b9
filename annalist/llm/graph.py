"""Connected components by propagation of the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b).

    Each round takes the smallest label among the neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of a component's diameter.
    Only links and labels move, and each round is a written table.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        lowest = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("low"))
        of_label = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        jumped = lowest.join(of_label, "low", "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("component")
        )
        new = stored(jumped, "labels")
        if new.join(labels, ["node", "component"], "left_anti").isEmpty():
            return new
        labels = new
