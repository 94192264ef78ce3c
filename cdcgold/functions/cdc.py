"""Column expressions over change-event rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata columns the capture step adds to every flattened row.
META_COLUMNS = ("__op", "__table", "__source_ts_ms", "__deleted")

# Operation codes of the capture step.
OPERATIONS = {"c": "insert", "u": "update", "d": "delete", "r": "snapshot"}


def is_deleted(columns: Iterable[str], *, exact: bool = False) -> Column:
    """True for a row that records a delete.

    The default ignores the case of the flag and also takes operation ``d``; ``exact``
    takes only the literal ``true`` or operation ``d``.
    """
    columns = set(columns)
    tests = []
    if "__deleted" in columns:
        flag = F.col("__deleted").cast("string")
        tests.append((flag if exact else F.lower(flag)) == "true")
    if "__op" in columns:
        tests.append(F.col("__op") == "d")
    if not tests:
        return F.lit(False)
    return F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*META_COLUMNS)


def table_of(topic: str | Column) -> Column:
    """Table name of a dotted topic: the part after the last dot."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    return F.substring_index(topic, ".", -1)


def key_text(column: str | Column) -> Column:
    """Document keys are text, whatever type the event carried."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("string")


def operation_name(op: str | Column = "__op") -> Column:
    op = F.col(op) if isinstance(op, str) else op
    mapping = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    return F.try_element_at(mapping, op)


def event_id(topic="topic", partition="partition", offset="offset") -> Column:
    """Stable identity of a log record: a digest of its coordinates."""
    return F.sha2(F.concat_ws("|", F.col(topic), F.col(partition), F.col(offset)), 256)
