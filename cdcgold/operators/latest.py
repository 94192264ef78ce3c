"""Latest row per key, and what is still alive of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.functions.cdc import is_deleted
from cdcgold.spec import ChildSpec, ProfileSpec

LOG_ORDER = ("partition", "offset")

# Where a row came from in the log; not part of the row.
POSITION = ("topic", "partition", "offset", "key", "timestamp", "batch_id")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """The newest row of every key.

    The rank filter is applied within each task before the shuffle as well as after it, so
    a key that holds a large share of the log sends one row per task.  Rows without a key
    are skipped.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    present = df.dropna(subset=list(keys))
    ranked = present.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def live(df: DataFrame) -> DataFrame:
    return df.where(~is_deleted(df.columns))


def snapshot_then_log(
    snapshot: DataFrame, log: DataFrame, order: Sequence[str] = LOG_ORDER
) -> DataFrame:
    """Snapshot rows, tagged as reads, ahead of every log row.

    The order columns of the snapshot are -1, so replaying the log over rows the snapshot
    already holds ends in the same state.
    """
    tagged = snapshot
    for c in order:
        tagged = tagged.withColumn(c, F.lit(-1).cast(log.schema[c].dataType))
    if "__op" in log.columns:
        tagged = tagged.withColumn("__op", F.lit("r"))
    if "__deleted" in log.columns:
        tagged = tagged.withColumn("__deleted", F.lit("false"))
    return tagged.unionByName(log, allowMissingColumns=True)


def current_root(spec: ProfileSpec, log: DataFrame, order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """One row per root key under the spec's delete policy, without its log position."""
    newest = latest(log, [spec.key], order).drop(*POSITION)
    gone = is_deleted(newest.columns)
    if spec.root_delete == "drop":
        return newest.where(~gone)
    if spec.root_delete == "mark":
        status = F.when(gone, F.lit("DELETED")).otherwise(F.col(spec.status_field))
        return newest.withColumn(spec.status_field, status)
    return newest


def current_child(
    spec: ProfileSpec, child: ChildSpec, log: DataFrame, order: Sequence[str] = LOG_ORDER
) -> DataFrame:
    """Live child rows under the spec's reparenting policy."""
    keys = list(child.pk)
    if spec.reparent == "keep_both":
        keys = [child.fk, *(k for k in keys if k != child.fk)]
    return live(latest(log, keys, order)).drop(*POSITION)
