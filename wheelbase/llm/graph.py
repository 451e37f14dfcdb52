"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelbase.llm.frames import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge.

    Each round gives a node the smallest of its label, the labels around it and the label of its label, so labels reach ever further and a chain
    of n nodes takes about log n rounds; a round is one stored table, made by combining and joining on nodes. The minimum combines before the shuffle, so a node with very many edges is no hot key.
    """
    both = written(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
        .select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y").distinct()
    )
    rows = both.count()
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), rows)
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("target"), F.col("component").alias("further"))
        met = labels.join(near, labels.node == near.x, "left").join(jump, labels.component == jump.target, "left")
        after = written(met.select("node", F.col("component").alias("old"), F.least("component", "near", "further").alias("component")), rows)
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels
