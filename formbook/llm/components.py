"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node it can reach.

    Smallest neighbour labels with pointer jumping: each round a node takes the
    smallest label among its neighbours and then that label's own label, so path
    lengths halve. Each round's labels are written to the shared folder, which
    cuts the lineage; the driver sees one count a round. Null ends, self links
    and repeated links are allowed; nodes without a link are not listed.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = materialise(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialise(links.groupBy("a").agg(F.min("b").alias("low"))
                         .select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        seen = (links.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        moved = (labels.join(seen, "node")
                 .select("node", F.least("root", "low").alias("next"), F.col("root").alias("was")))
        moved = materialise(moved, "moved")
        above = moved.select(F.col("node").alias("next"), F.col("next").alias("up"))
        new = materialise(moved.join(above, "next").select("node", F.least("next", "up").alias("root"),
                                                           (F.least("next", "up") < F.col("was")).alias("changed")), "labels")
        labels = new.select("node", "root")
        if new.where("changed").limit(1).count() == 0:
            return labels
