"""Connected components of link rows, every step a join of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.session import materialise


def labelled(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of long links (a, b): the lowest node that each reaches.

    Every node points to a lower one.  A round lets each node's whole neighbourhood point to the
    lowest label seen there, and then follows the pointers once more, so paths halve at least;
    the rounds end when nothing changes.  Hubs are shrunk by partial minima before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct(), "links")
    state = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels"
    )
    while True:
        # the lowest label among the neighbours, offered to the node and to the node's own label
        seen = edges.join(state.select(F.col("node").alias("b"), "label"), "b")
        best = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        offers = state.join(best, "node", "left").select(
            "node", "label", F.least("label", "near").alias("low")
        )
        given = offers.select("node", "low").unionByName(offers.select(F.col("label").alias("node"), "low"))
        hooked = given.groupBy("node").agg(F.min("low").alias("low"))
        jumped = hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left")
        now = materialise(jumped.select("node", F.coalesce("next", "low").alias("label")), "labels")
        settled = now.join(state.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        state = now
        if settled:
            return state.withColumnRenamed("label", "component")
