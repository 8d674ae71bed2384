"""Connected components of a table of links, as joins that repeat until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.streaming.storage import written


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` (long) to ``node``, ``component``: the smallest node that links lead to. Nodes without links are absent.

    In each round every node learns the smallest label among its neighbours, then looks up the label of its label; the
    second step halves the way to go, so a chain of n links takes about log n rounds. Labels and links are tables in the
    shared folder between rounds. A node with very many links gets its smallest neighbour from a combining aggregate.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
            .select(F.col("a").alias("node"), "m")
        )
        met = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        roots = met.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = met.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"), "old")
        step = written(jumped, "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels
