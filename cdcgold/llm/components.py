"""Connected components by alternating star contraction, every round a few joins of link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.session import materialise


def _lowest(links: DataFrame) -> DataFrame:
    """By node `u`: the lowest of it and its neighbours `v`."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large(links: DataFrame) -> DataFrame:
    """Link every higher neighbour of a node to the node's lowest one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = both.filter("v > u").join(_lowest(both), "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the lowest of them; links run downwards here."""
    down = links.join(_lowest(links), "u")
    own = down.select("u", F.col("m").alias("v"))
    others = down.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(others).filter("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every linked node and the lowest node that it reaches.

    Links with a null end and from a node to itself are ignored; order and repetition of links
    do not matter.  Nodes without links are not in the result.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = links.filter("u > v").distinct()
    state, before = materialise(links, "links"), None
    while True:
        digest = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if digest == before:
            break
        before = digest
        state = materialise(_small(_large(state)), "stars")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
