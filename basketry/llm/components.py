"""Connected components of a table of links, by minimum labels and pointer
jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C


def connected_components(links: DataFrame, merge: bool = False) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b); root is the smallest node
    that can be reached. Each round takes the least label next door, then the
    label's own label, so rounds grow with the logarithm of a path's length. ``merge``:
    join by merging, as a small table's hash tables, several a round, pile up on the driver."""
    def side(table: DataFrame) -> DataFrame:
        return table.hint("merge") if merge else table

    both = C.stored(links.select(F.col("a").alias("node"), F.col("b").alias("next"))
                    .union(links.select("b", "a")).distinct(), "links")
    labels = C.stored(both.groupBy("node").agg(F.min("next").alias("next"))
                      .select("node", F.least("node", "next").alias("root")), "labels")
    while True:
        reached = (both.join(side(labels.select(F.col("node").alias("next"), "root")), "next")
                   .groupBy("node").agg(F.min("root").alias("least")))
        nearer = labels.join(side(reached), "node").select("node", "root", F.least("root", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        moved = C.stored(nearer.join(side(jump), "to", "left").select(
            "node", F.least("to", "beyond").alias("root"), (F.col("root") > F.least("to", "beyond")).alias("moved")),
            "labels")
        labels = moved.select("node", "root")
        if not moved.agg(F.max("moved")).collect()[0][0]:
            return labels
