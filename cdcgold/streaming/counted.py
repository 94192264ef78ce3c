"""Views of documents kept by counts.

A view is the rows that each document gives, with how often each row is given.  A batch takes off
what its documents gave before it, adds what they give now, and changes only the counts that differ;
nothing is computed anew from all documents, whatever leaves or joins a view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.operators.decode import schema_of
from cdcgold.operators.views import first_slices
from cdcgold.session import materialise
from cdcgold.streaming.keyed import KeyedTable

COUNT = "n"
DAY, AT = "day", "at"
_DAY_MS = 86_400_000


class CountedView:
    """``rows`` maps documents to the view's rows, whose columns are those of ``schema``.

    Rows are bucketed by the column ``by``, so that a batch and a read by that column take the files
    of some buckets only.  Rows with a null are not kept.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        by: str,
        rows: Callable[[DataFrame], DataFrame],
        *,
        buckets: int = 64,
    ):
        fields = schema_of(schema).fields
        self.keys, self.by, self.given = [f.name for f in fields], by, rows
        counted = T.StructType([*fields, T.StructField(COUNT, T.LongType())])
        self.table = KeyedTable(spark, path, counted, self.keys, by=by, buckets=buckets)

    def _signed(self, docs: DataFrame, sign: int) -> DataFrame:
        return self.given(docs).select(*self.keys, F.lit(sign).cast("bigint").alias(COUNT))

    def apply(self, before: DataFrame, after: DataFrame, batch_id: int) -> None:
        """Take in a batch: the touched documents as they were before it, and as they are now.

        Running it again with the same id gives the same view.
        """
        both = self._signed(before, -1).unionByName(self._signed(after, 1)).dropna(subset=self.keys)
        change = both.groupBy(*self.keys).agg(F.sum(COUNT).alias(COUNT)).where(F.col(COUNT) != 0)
        change = materialise(change, "view-change")
        known = self.table.current(change.select(self.by).distinct(), before=batch_id)
        marked = change.withColumn("_new", F.lit(True)).unionByName(
            known.select(*self.keys, COUNT, F.lit(False).alias("_new"))
        )
        counts = marked.groupBy(*self.keys).agg(F.sum(COUNT).alias(COUNT), F.max("_new").alias("_new"))
        self.table.append(counts.where("_new"), batch_id)

    def take_feed(self, feed: DataFrame, batch_id: int) -> None:
        """The same from a change feed with ``before`` and ``after`` images of whole documents."""
        images = [feed.where(F.col(i).isNotNull()).select(f"{i}.*") for i in ("before", "after")]
        self.apply(*images, batch_id)

    def counts(self, wanted: DataFrame | None = None) -> DataFrame:
        """Rows and their counts; ``wanted``: only for these values of ``by``."""
        rows = self.table.current(None if wanted is None else wanted.distinct())
        return rows.where(F.col(COUNT) > 0).select(*self.keys, COUNT)

    def compact(self) -> None:
        """Fold the batches so far; rows that are given no more go."""
        self.table.compact(lambda rows: rows.where(F.col(COUNT) != 0))


def by_field(spark: SparkSession, path: str, field: str, kind: str = "string", **options) -> CountedView:
    """How many documents have each value of a root field."""
    rows = lambda docs: first_slices(docs).select(field)
    return CountedView(spark, path, f"{field} {kind}", field, rows, **options)


def by_edge(
    spark: SparkSession, path: str, key: str, array: str, end: str, kind: str = "bigint", **options
) -> CountedView:
    """Which documents have edges to each end, and how many: the reverse index of an array."""

    def rows(docs: DataFrame) -> DataFrame:
        return docs.select(F.explode(array).alias("_e"), key).select(F.col("_e")[end].alias(end), key)

    return CountedView(spark, path, f"{end} {kind}, {key} {kind}", end, rows, **options)


class NewestView:
    """The newest documents by a field of milliseconds, found without sorting all of them.

    Documents are listed by day, and days are counted; a read takes the last days that hold enough
    documents, and sorts those.  Documents without a time are not listed.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, field: str, kind: str = "bigint", buckets: int = 64
    ):
        day = F.floor(F.col(field) / _DAY_MS).cast("bigint").alias(DAY)
        self.key = key
        self.days = CountedView(
            spark, f"{path}/days", f"{DAY} bigint", DAY, lambda docs: first_slices(docs).select(day), buckets=1
        )
        self.listed = CountedView(
            spark, f"{path}/listed", f"{DAY} bigint, {AT} bigint, {key} {kind}", DAY,
            lambda docs: first_slices(docs).select(day, F.col(field).alias(AT), key), buckets=buckets,
        )

    def views(self) -> list[CountedView]:
        return [self.days, self.listed]

    def newest(self, n: int) -> DataFrame:
        """Keys and times of the n newest documents, ties by key."""
        later = Window.orderBy(F.col(DAY).desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
        enough = F.coalesce(F.sum(COUNT).over(later), F.lit(0)) < n
        days = self.days.counts().select(DAY, enough.alias("_wanted")).where("_wanted").select(DAY)
        listed = self.listed.counts(materialise(days, "newest-days"))
        return listed.orderBy(F.col(AT).desc(), self.key).limit(n).select(self.key, AT)
