"""Connected components of an edge table by label passing, a few small joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges(src, dst): comp is the smallest node that edges reach.

    Each round takes the least label among the neighbours and then the label of that label, so
    chains shorten by halves. Every round is written to the shared folder. No edges: no rows.
    """
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        onward = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = stored(step.join(onward, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        moved = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels
