"""Connected components of large graphs, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, label): the smallest node reachable from each.

    Every round takes the smallest label among a node and its neighbours, then
    that label's own label, so the distance covered doubles. Rounds end when
    nothing changes; each is written to shared storage.
    """
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("near"))
        # A label is a node with a label of its own.
        own = labels.select(F.col("node").alias("n"), F.col("label").alias("further"))
        jumped = stepped.join(own, F.col("near") == F.col("n"))
        new = written(jumped.select("node", F.col("label").alias("old"), F.least("near", "further").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
