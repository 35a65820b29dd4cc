"""Connected components of links that are far fewer than the documents, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node that it reaches) of every node in `links` (a, b: long).

    Each round, a node takes the least label among its own and its neighbours', then the label of that label. Labels are
    written every round, and nothing but the number of changes comes to the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = save(both, "links")
    labels = save(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = save(step, "labels")
        top = step.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        labels = save(step.join(top, step.comp == top._n, "left").select("node", "old", F.least("comp", F.coalesce(F.col("_c"), F.col("comp"))).alias("comp")), "labels")
        if labels.filter("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
