"""Connected components of an edge table, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import materialise, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node that an edge touches; root is the smallest node reachable.

    Labels start at the smallest neighbour; each round takes the smallest label
    among neighbours and then the label's own label, so a chain shortens by more
    than half a round and a star ends in two.  Each round is stored, and only a
    count of changed labels reaches the driver.
    """
    with scratch(edges.sparkSession) as own:
        both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
        labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near")).select("node", F.least("node", "_near").alias("root")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
            lower = labels.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
            jump = labels.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            new = materialise(lower.join(jump, "root", "left").select("node", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")), "labels")
            labels = new.select("node", "root")
            if not new.filter("root <> _old").limit(1).count():
                own.keep(new)
                return labels
