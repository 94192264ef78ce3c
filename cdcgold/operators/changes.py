"""Change feed between two versions of a keyed table, and patching documents from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.functions.arrays import apply_changes
from cdcgold.functions.values import slot
from cdcgold.operators.latest import latest
from cdcgold.spec import ChildSpec

# Operation types of a change feed.
FEED_OPERATIONS = ("insert", "update", "replace", "delete")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """insert / update / delete per changed key, with both images; unchanged rows drop out."""
    rest = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*rest).alias("before"))
    after = new.select(*keys, F.struct(*rest).alias("after"))
    joined = before.join(after, list(keys), "full_outer")
    op = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("after").isNull(), "delete")
        .when(~F.col("before").eqNullSafe(F.col("after")), "update")
    )
    feed = joined.withColumn("operation", op).where(F.col("operation").isNotNull())
    return feed.select(*keys, "operation", "before", "after")


def only(feed: DataFrame, operations: Sequence[str] = FEED_OPERATIONS) -> DataFrame:
    return feed.where(F.col("operation").isin(*operations))


def patch_arrays(
    docs: DataFrame,
    key: str,
    child: ChildSpec,
    feed: DataFrame,
    order: Sequence[str],
) -> DataFrame:
    """Apply a batch of child changes to the documents' array.

    ``feed``: parent key ``key``, single-column child key, ``operation`` and the embedded
    fields, ordered by ``order``.  The last change of each element counts; a changed element
    moves to the end of its array, in change order.  Changes of unknown parents are skipped.
    Changes of a document in several segments go to the segment of their element, so no
    group outgrows a segment by more than the batch brings to it.
    """
    (pk,) = child.pk
    by = [key]
    last = latest(feed, [key, pk], order)
    if "segments" in docs.columns:
        by = [key, "segment"]
        split = docs.where((F.col("segments") > 1) & (F.col("segment") == 0)).select(key, "segments")
        last = last.join(split, key, "left")
        number = F.when(F.col("segments").isNull(), 0).otherwise(slot([F.col(pk)], F.col("segments")))
        last = last.withColumn("segment", number)
    element = docs.schema[child.array].dataType.elementType
    item = F.struct(*[F.col(n).cast(element[n].dataType).alias(n) for n in element.names])
    gone = F.col("operation") == "delete"
    live = F.collect_list(F.when(~gone, F.struct(*order, item.alias("_item"))))
    per_parent = last.groupBy(*by).agg(
        F.collect_list(F.col(pk).cast(element[pk].dataType)).alias("_changed"),
        F.transform(F.sort_array(live), lambda e: e["_item"]).alias("_live"),
    )
    joined = docs.join(per_parent, by, "left")
    patched = apply_changes(child.array, pk, F.col("_changed"), F.col("_live"))
    touched = F.col("_changed").isNotNull()
    value = F.when(touched, patched).otherwise(F.col(child.array))
    return joined.withColumn(child.array, value).select(*docs.columns)
