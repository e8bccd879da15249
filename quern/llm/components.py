"""Connected components of a graph in a table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b): label is the least vertex that v reaches.

    Labels only fall; a round takes the least label among the neighbours, then the label of the label,
    so that a chain's length halves each round. Every round is stored in the shared folder."""
    ends = edges.where("a != b")
    both = stored(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("least"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        hop = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(hop, "label", "left").select("v", "before", F.least("label", "further").alias("label")), "labels")
        old, labels = labels, after.select("v", "label")
        release(edges.sparkSession, old)
        if after.where("label != before").isEmpty():
            return labels
