"""Element operators on arrays of structs and on maps, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_by_key(arr: str | Column, field: str, key: Column) -> Column:
    """The array without elements whose ``field`` equals ``key``."""
    return F.filter(_col(arr), lambda x: ~x[field].eqNullSafe(key))


def append_element(arr: str | Column, element: Column) -> Column:
    """The array with one more element; a missing array counts as empty."""
    arr = _col(arr)
    return F.coalesce(F.array_append(arr, element), F.array(element))


def upsert_element(arr: str | Column, field: str, element: Column) -> Column:
    """Replace the element of the same key; the new one comes last."""
    return append_element(remove_by_key(arr, field, element[field]), element)


def apply_changes(arr: str | Column, field: str, changed: Column, live: Column) -> Column:
    """Many removals and upserts at once: drop every changed key, then add the live elements."""
    kept = F.filter(_col(arr), lambda x: ~F.coalesce(F.array_contains(changed, x[field]), F.lit(False)))
    return F.when(_col(arr).isNull(), live).when(live.isNull(), kept).otherwise(F.concat(kept, live))


def map_put(m: str | Column, key: Column, value: Column) -> Column:
    return F.map_concat(map_remove(m, key), F.create_map(key, value))


def map_remove(m: str | Column, key: Column) -> Column:
    return F.map_filter(_col(m), lambda k, v: k != key)


def map_to_array(m: str | Column) -> Column:
    """Values of a map in the order of its keys."""
    entries = F.sort_array(F.map_entries(_col(m)))
    return F.transform(entries, lambda e: e["value"])


def first_element(arr: str | Column) -> Column:
    return F.get(_col(arr), F.lit(0))


def size_or_zero(arr: str | Column) -> Column:
    arr = _col(arr)
    return F.when(arr.isNull(), 0).otherwise(F.size(arr))
