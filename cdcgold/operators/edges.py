"""Joins with edge tables whose rows belong to either of two ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def either_end(edges: DataFrame, from_col: str, to_col: str, key: str) -> DataFrame:
    """One row per edge and distinct end, so that an equi-join replaces ``from = k OR to = k``."""
    ends = F.array_distinct(F.array(F.col(from_col), F.col(to_col)))
    exploded = edges.withColumn(key, F.explode(ends))
    return exploded.where(F.col(key).isNotNull())


def one_end(edges: DataFrame, from_col: str, key: str) -> DataFrame:
    return edges.where(F.col(from_col).isNotNull()).withColumn(key, F.col(from_col))


def left_join_many(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Left join of unique parents with rows of which one parent may have very many.

    The optimizer splits a skewed side only where that side is not the null-supplying one,
    so matches come from an inner join and parents without rows from an anti-join.
    """
    matched = parents.join(rows, key)
    bare = parents.join(rows.select(key).distinct(), key, "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)
