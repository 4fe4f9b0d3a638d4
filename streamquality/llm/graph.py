"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b`` (longs): the smallest node it is joined with.

    Each round takes the smallest label among the neighbours, then the label's own label, so
    distances halve; labels are written each round, which cuts the lineage. The driver sees one
    count a round. Repeated edges and loops are harmless; no edges give no nodes."""
    pairs = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    labels = both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
    while True:
        labels = stage(labels, "labels")
        offered = both.join(labels.withColumnsRenamed({"node": "other", "root": "offer"}), "other").groupBy("node").agg(F.min("offer").alias("offer"))
        nearer = labels.join(offered, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        own = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        after = stage(nearer.join(own, "root").select("node", "was", F.least("root", "jump").alias("root")), "labels")
        if after.filter("was <> root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
