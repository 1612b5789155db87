"""Connected components by spreading the smallest label; no vertex's neighbours ever meet in one task.

Each round joins the edges with the labels of their far ends, takes the smallest per vertex (map-side first), and then follows
labels of labels, so chains shorten by halves. Rounds are staged tables. Hot vertices are large only on the join's edge side,
where adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.storage import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the edges (u, v): root is the smallest vertex of its component."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = staged(step.join(jump, "root", "left").select("node", F.least("root", "far").alias("root"), "old"), "labels")
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
