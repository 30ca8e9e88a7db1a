"""Connected components of a table of links, as a table: nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): the least node that it reaches. Labels spread to neighbours and jump to their label's label, so rounds grow with the logarithm of a component's diameter, near enough."""
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        moved = written(step.join(up, "new").select("node", "label", F.least("new", "up").alias("new")), "labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("label <> new").isEmpty():
            return labels
