"""Patching documents straight from a stream of changes, without rebuilding them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.operators.changes import only, patch_arrays
from cdcgold.operators.latest import latest
from cdcgold.operators.merge import patch_upsert, soft_delete
from cdcgold.session import materialise, scratch
from cdcgold.spec import ChildSpec
from cdcgold.streaming.keyed import KeyedTable

# Fixed value: the name under which the position of the root's own changes is kept.
ROOT = ""
# Whether the last change removed the element; its log partition, and the highest position seen there.
REMOVED, PARTITION, TOP = "_removed", "_partition", "_top"


class ChangeApplier:
    """Applies root and child changes to a keyed table of one-row documents, in any order.

    ``feeds``: array field -> function from a micro-batch to that child's change feed, and
    ``root`` from a micro-batch to root patches; where these have an ``operation``, a delete only
    marks ``status_field``.  The position (``order``) last applied to each element, removed ones
    included, and to each root is kept in a second table; older changes are ignored, and changed
    elements stand in the order of their changes behind those never changed.  So the result
    depends neither on how records are cut into batches nor on their order.  Changes of a child
    whose document does not exist are lost, as patching in place has nowhere to keep them.

    A rerun of a batch reads earlier batches only.

    ``lateness`` bounds the memory of removed elements: per value of ``partition`` (a column of the
    feeds; none: one for all) the highest position (last column of ``order``) of earlier batches less
    the lateness is the low mark.  Changes at or below it are refused as too late, so positions of
    removed elements there decide nothing and go when the tables are compacted, every
    ``compact_every`` batches.  None remembers them for ever.
    """

    def __init__(
        self,
        docs: KeyedTable,
        key: str,
        children: Sequence[ChildSpec],
        feeds: Mapping[str, object],
        order: Sequence[str],
        *,
        root=None,
        set_columns: Sequence[str] = (),
        set_on_insert: Sequence[str] = (),
        status_field: str = "status",
        lateness: int | None = None,
        partition: str | None = None,
        compact_every: int | None = 16,
    ):
        self.lateness, self.partition, self.compact_every = lateness, partition, compact_every
        self.docs, self.key, self.children, self.feeds = docs, key, list(children), feeds
        self.order, self.root, self.status_field = list(order), root, status_field
        self.set_columns, self.set_on_insert = list(set_columns), list(set_on_insert)
        names = [key, "_array", "_element"]
        kinds = [docs.schema[key].dataType, T.StringType(), T.StringType()]
        fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
        fields += [T.StructField(c, T.LongType()) for c in self.order]
        fields += [T.StructField(REMOVED, T.BooleanType()), T.StructField(PARTITION, T.StringType())]
        self.applied = KeyedTable(
            docs.spark, f"{docs.path}-applied", T.StructType(fields), names, by=key, buckets=docs.buckets
        )
        self.marks = KeyedTable(
            docs.spark, f"{docs.path}-marks", T.StructType([T.StructField(PARTITION, T.StringType()), T.StructField(TOP, T.LongType())]),
            [PARTITION], by=PARTITION, order=(TOP,), buckets=1,
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with scratch(self.docs.spark):
                docs, applied, tops = self._patched(batch, batch_id)
                self.applied.append(applied, batch_id)
                self.marks.append(tops, batch_id)
                self.docs.append(docs, batch_id)
                if self.compact_every and batch_id % self.compact_every == self.compact_every - 1:
                    self.compact()
        finally:
            batch.unpersist()

    def compact(self) -> None:
        """Fold the tables into one base each, without positions that no change can come below."""
        self.applied.compact(self._needed)
        for table in (self.docs, self.marks):
            table.compact()
        for table in (self.docs, self.applied, self.marks):
            table.vacuum(keep=1)

    def _low(self, before: int | None = None) -> DataFrame:
        """(partition, low mark); a row per log partition."""
        tops = self.marks.current(before=before)
        low = F.lit(None).cast("long") if self.lateness is None else F.col(TOP) - self.lateness
        return F.broadcast(tops.select(PARTITION, low.alias("_low")))

    def _needed(self, applied: DataFrame) -> DataFrame:
        late = F.col(self.order[-1]) <= F.col("_low")
        known = applied.join(self._low(), PARTITION, "left")
        return known.where(~(F.col(REMOVED) & F.coalesce(late, F.lit(False)))).select(*applied.columns)

    def _in_time(self, feed: DataFrame, batch_id: int) -> DataFrame:
        """Changes above the low mark of their log partition."""
        own = F.lit("") if self.partition is None else F.coalesce(F.col(self.partition).cast("string"), F.lit(""))
        named = feed.withColumn(PARTITION, own)
        if self.lateness is None:
            return named
        late = F.coalesce(F.col(self.order[-1]) <= F.col("_low"), F.lit(False))
        return named.join(self._low(batch_id), PARTITION, "left").where(~late).select(*named.columns)

    def _at(self) -> Column:
        return F.struct(*[F.col(c).cast("long").alias(c) for c in self.order])

    def _fresh(self, feed: DataFrame, array: str, element, applied: DataFrame) -> DataFrame:
        """The newest change of each element, if none as new was applied before."""
        known = applied.where(F.col("_array") == array).select(self.key, "_element", self._at().alias("_seen"))
        named = feed.withColumn("_element", element)
        last = latest(named, [self.key, "_element"], self.order).withColumn("_now", self._at())
        fresh = last.join(known, [self.key, "_element"], "left")
        fresh = fresh.where(F.col("_seen").isNull() | (F.col("_now") > F.col("_seen"))).drop("_seen", "_now")
        return materialise(fresh, "fresh-changes")

    def _patched(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The documents the batch touches, after its changes; the positions applied; the highest ones."""
        feeds = {c.array: self._in_time(only(self.feeds[c.array](batch)), batch_id) for c in self.children}
        patch = None if self.root is None else self._in_time(self.root(batch), batch_id)
        sources = [*feeds.values()] if patch is None else [*feeds.values(), patch]
        touched = reduce(DataFrame.unionByName, [s.select(self.key) for s in sources]).dropna().distinct()
        touched = materialise(touched, "touched")
        applied = materialise(self.applied.current(touched, before=batch_id), "applied")

        for c in self.children:
            feeds[c.array] = self._fresh(feeds[c.array], c.array, F.col(c.pk[0]).cast("string"), applied)
        top = F.max(F.col(self.order[-1]).cast("long")).alias(TOP)
        tops = reduce(DataFrame.unionByName, [s.select(PARTITION, self.order[-1]) for s in sources])
        tops = materialise(tops.groupBy(PARTITION).agg(top), "tops")
        gone = (F.col("operation") == "delete").alias(REMOVED)
        marks = [
            f.select(self.key, F.lit(a).alias("_array"), "_element", *self.order, gone, PARTITION)
            for a, f in feeds.items()
        ]
        docs = self.docs.current(touched, before=batch_id).drop("batch_id")
        if patch is not None:
            patch = self._fresh(patch, ROOT, F.lit(ROOT), applied)
            never = F.lit(False).alias(REMOVED)
            marks.append(patch.select(self.key, F.lit(ROOT).alias("_array"), "_element", *self.order, never, PARTITION))
            docs = self._root_patched(docs, patch.drop(PARTITION))
        now = reduce(DataFrame.unionByName, marks).dropna(subset=[self.key])
        for c in self.children:
            docs = patch_arrays(docs, self.key, c, feeds[c.array].drop(PARTITION), self.order)
            docs = self._in_order(docs, c, applied.drop("batch_id").unionByName(now))
        return docs, now, tops

    def _root_patched(self, docs: DataFrame, patch: DataFrame) -> DataFrame:
        gone = F.lit(False)
        if "operation" in patch.columns:
            gone = F.col("operation") == "delete"
        columns = docs.columns
        docs = patch_upsert(docs, patch.where(~gone), [self.key], self.set_columns, self.set_on_insert)
        docs = soft_delete(docs, patch.where(gone).select(self.key), self.key, self.status_field)
        for c in self.children:
            empty = F.array().cast(docs.schema[c.array].dataType)
            docs = docs.withColumn(c.array, F.coalesce(F.col(c.array), empty))
        return docs.select(*columns)

    def _in_order(self, docs: DataFrame, child: ChildSpec, applied: DataFrame) -> DataFrame:
        """Elements never changed first, as they were, then changed ones by their last change.

        Positions stay rows, joined to the elements a document has; removed ones take no part.
        """
        mine = applied.where((F.col("_array") == child.array) & ~F.col(REMOVED))
        newest = mine.groupBy(self.key, "_element").agg(F.max(self._at()).alias("_at"))
        here = docs.select(self.key, F.posexplode(child.array).alias("_i", "_e"))
        here = here.withColumn("_element", F.col("_e")[child.pk[0]].cast("string"))
        placed = here.join(newest, [self.key, "_element"], "left").groupBy(self.key)
        placed = placed.agg(F.collect_list(F.struct("_at", "_i", "_e")).alias("_placed"))
        ordered = F.transform(F.array_sort("_placed", _before), lambda x: x["_e"])
        joined = docs.join(placed, self.key, "left")
        # without a placed element the array is empty, or null, and stays so
        return joined.withColumn(child.array, F.coalesce(ordered, F.col(child.array))).select(*docs.columns)

    def start(self, stream: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None = None):
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _before(a: Column, b: Column) -> Column:
    """Compares by position, nulls first, then by index."""
    x, y = a["_at"], b["_at"]
    first = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1)
    by_place = first.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(by_place != 0, by_place).otherwise(a["_i"] - b["_i"])
