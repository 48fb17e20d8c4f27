"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of long ids; the component is its smallest node.

    Every round takes the smallest label among a node and its neighbours, then the label of that
    label, so distances shrink by half or better. Labels are written down each round; nothing is
    gathered on the driver but the number of changes. Edges should be few beside the data (a spanning
    forest); a node with very many of them is split by the skewed-join handling of Spark.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("low"), F.col("component").alias("before")
        )
        of = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        # A label is a node of the graph, so every row finds its label's label.
        changed = low.join(of, "low").select("node", F.least("low", "jump").alias("component"), "before")
        changed = materialize(changed, "labels")
        labels = changed.select("node", "component")
        if not changed.filter(F.col("component") != F.col("before")).limit(1).count():
            return labels
