"""Relational table scans: parquet extracts, or a database over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{table}.parquet")


def range_predicates(key: str, bounds: Sequence) -> list[str]:
    """WHERE clauses that split a table at key values, which an index on the key can serve.

    The first part has all keys below the first bound and those that are null, the last one all
    from the last bound on; so the parts are disjoint and complete whatever the bounds are.
    """
    cuts = [str(b) if isinstance(b, (int, float)) else "'" + str(b).replace("'", "''") + "'" for b in bounds]
    if not cuts:
        return ["1 = 1"]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *between, f"{key} >= {cuts[-1]}"]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: Sequence,
    *,
    columns: Sequence[str] | None = None,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Scan a table through several connections, each reading one range of an indexed key.

    ``bounds``: ascending key values to cut at, for example from the database's own statistics.
    """
    settings = {"fetchsize": str(fetch_size), **(properties or {})}
    df = spark.read.jdbc(url, table, predicates=range_predicates(key, bounds), properties=settings)
    return df.select(*columns) if columns else df
