"""Keyed table maintenance as DataFrame plans: target and changes in, new target out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.operators.graph import labelled
from cdcgold.session import materialise, materialise_counted

#: ``insert_ignore`` with several keys: rounds before what is left is settled in order, and the rows
#: that one task settles at most.
ROUNDS = 2
SETTLE_ROWS = 1 << 20


def replace_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-row replace by key; the batch holds each key once."""
    untouched = target.join(batch.select(*keys), list(keys), "left_anti")
    return untouched.select(*target.columns).unionByName(batch)


def upsert_counts(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many batch rows insert, change an existing row, or match one without a change."""
    rest = [c for c in batch.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("_old"))
    new = batch.select(*keys, F.struct(*rest).alias("_new"))
    joined = new.join(old, list(keys), "left")
    missing = F.col("_old").isNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return joined.agg(
        F.count_if(missing).alias("inserted"),
        F.count_if(~missing & ~same).alias("changed"),
        F.count_if(~missing & same).alias("matched"),
    )


def patch_upsert(
    target: DataFrame,
    patch: DataFrame,
    keys: Sequence[str],
    set_columns: Sequence[str],
    set_on_insert: Sequence[str] = (),
    insert: bool = True,
) -> DataFrame:
    """Set the listed columns of existing rows; insert missing ones with ``set_on_insert`` too."""
    renamed = patch.select(
        *keys,
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_p_{c}") for c in (*set_columns, *set_on_insert)],
    )
    known = target.withColumn("_known", F.lit(True))
    joined = known.join(renamed, list(keys), "full_outer" if insert else "left")
    out = []
    for c in target.columns:
        if c in set_columns:
            value = F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c))
        elif c in set_on_insert:
            value = F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_p_{c}"))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    return joined.select(*out)


def soft_delete(
    target: DataFrame,
    deletes: DataFrame,
    key: str,
    status: str = "status",
    updated_at: str | None = None,
    mark: str = "DELETED",
) -> DataFrame:
    """Mark deleted rows; deletes of unknown keys change nothing."""
    patch = deletes.withColumn(status, F.lit(mark))
    columns = [status] + ([updated_at] if updated_at else [])
    return patch_upsert(target, patch, [key], columns, insert=False)


def _first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    present = rows.where(F.col(key).isNotNull())
    return present.groupBy(key).agg(F.min(order).alias(order))


def _without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        rows = rows.join(other.select(k).where(F.col(k).isNotNull()), k, "left_anti")
    return rows


def insert_ignore(
    target: DataFrame, batch: DataFrame, unique_keys: Sequence[str], order: str
) -> DataFrame:
    """Rows of the batch that inserting one by one in ``order`` would let in.

    ``order`` is unique in the batch.  A row is refused when any of its unique keys is in
    the target or was let in before it; a null key never collides.  With one key the first
    row of each key wins.  With several, a refused row must not block others, so winners
    are settled in rounds: those first in all their keys are in, rows colliding with them
    are out, and the rest play again.  The first of the remaining rows always wins, so the
    rounds end.
    """
    if len(unique_keys) == 1:
        key = unique_keys[0]
        rest = [c for c in batch.columns if c != key]
        fresh = _without(batch, target, unique_keys)
        nulls = fresh.where(F.col(key).isNull())
        first = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.min_by(F.struct(*rest), F.col(order)).alias("_first")
        )
        return first.select(key, "_first.*").select(*batch.columns).unionByName(nulls)

    rows, left = materialise_counted(_without(batch, target, unique_keys), "insert-candidates")
    accepted, rounds = [], 0
    while left:
        if rounds >= ROUNDS and (done := _settled(rows, left, unique_keys, order)) is not None:
            accepted.append(done)
            break
        winners = rows
        for k in unique_keys:
            first = _first_by(rows, k, order).select(order).unionByName(
                rows.where(F.col(k).isNull()).select(order)
            )
            winners = winners.join(first, order, "left_semi")
        winners = materialise(winners.select(*batch.columns), "insert-winners")
        accepted.append(winners)
        rest = rows.join(winners.select(order), order, "left_anti")
        rows, left = materialise_counted(_without(rest, winners, unique_keys), "insert-candidates")
        rounds += 1
    if not accepted:
        return batch.limit(0)
    return reduce(DataFrame.unionByName, accepted).select(*batch.columns)


def _settled(rows: DataFrame, left: int, unique_keys: Sequence[str], order: str) -> DataFrame | None:
    """The rows that get in, each component of colliding rows settled in one ordered pass in one task.

    Few rows are one group.  More are grouped by whole components; None if one of them alone has
    too many rows for a task, so that further rounds must shrink it first.
    """
    if left <= SETTLE_ROWS:
        return materialise(_passes(rows.withColumn("_group", F.lit(0)), unique_keys, order), "insert-settled")
    number = F.xxhash64(order)  # unique as the order is, but for chance, which only joins components
    links = [rows.select(number.alias("a"), F.xxhash64(F.lit(k), k).alias("b")).where(F.col(k).isNotNull())
             for k in unique_keys]
    found = materialise(labelled(reduce(DataFrame.unionByName, links)), "insert-components")
    placed = materialise(rows.withColumn("node", number).join(found, "node", "left").drop("node"), "insert-placed")
    largest = placed.groupBy("component").count().agg(F.max("count")).first()[0]
    if largest > SETTLE_ROWS:
        return None
    groups = -(-left // SETTLE_ROWS)
    grouped = placed.withColumn("_group", F.pmod(F.xxhash64(F.coalesce("component", number)), F.lit(groups)).cast("int"))
    return materialise(_passes(grouped.drop("component"), unique_keys, order), "insert-settled")


def _passes(rows: DataFrame, unique_keys: Sequence[str], order: str) -> DataFrame:
    keys = list(unique_keys)

    def settle(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        seen: list[set] = [set() for _ in keys]
        values = list(zip(*(group.column(k).to_pylist() for k in keys), strict=True))
        inside = []
        for row in values:
            fresh = not any(v is not None and v in s for v, s in zip(row, seen, strict=True))
            inside.append(fresh)
            if fresh:
                for v, s in zip(row, seen, strict=True):
                    s.add(v)
        return group.filter(pa.array(inside, pa.bool_()))

    return rows.groupBy("_group").applyInArrow(settle, rows.schema).drop("_group")


def append_ignore(
    target: DataFrame, batch: DataFrame, unique_keys: Sequence[str], order: str
) -> DataFrame:
    """Target plus the rows ``insert_ignore`` lets in."""
    accepted = insert_ignore(target, batch, unique_keys, order)
    return target.unionByName(accepted.select(*target.columns))


def point_updates(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    fields: Sequence[str],
    updated_at: str | None = None,
) -> DataFrame:
    """Apply rows of (key, field, value, seq[, updated_at]); the last value of a field wins.

    A key that gets many updates is reduced to one value per field before it is shuffled.
    """
    aggregates = []
    for f in fields:
        hit = F.when(F.col("field") == f, F.struct("value"))
        aggregates.append(F.max_by(hit, F.when(F.col("field") == f, F.col("seq"))).alias(f"_u_{f}"))
    if updated_at:
        aggregates.append(F.max(updated_at).alias(f"_u_{updated_at}"))
    # only the named fields exist, so another field's update must not bump updated_at
    known = updates.where(F.col("field").isin(*fields))
    last = known.groupBy(key).agg(*aggregates)
    joined = target.join(last, key, "left")
    out = []
    for c in target.columns:
        value: Column = F.col(c)
        if c in fields:
            new = F.col(f"_u_{c}")
            value = F.when(new.isNotNull(), new["value"].cast(target.schema[c].dataType)).otherwise(value)
        elif c == updated_at:
            value = F.coalesce(F.col(f"_u_{c}"), value)
        out.append(value.alias(c))
    return joined.select(*out)
