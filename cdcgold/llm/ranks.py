"""Gapless numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.session import materialise


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with a long column that counts from 0 within each value of the int column `group`.

    Rows are dealt by ranges of `order`, which should hardly tie; each task counts its own rows by
    group, and a running sum over tasks, a few rows each, gives where its numbers begin.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            value = batch.column(group).to_numpy(zero_copy_only=False)
            at = np.empty(len(value), np.int64)
            for v in np.unique(value).tolist():
                own = np.flatnonzero(value == v)
                at[own] = np.arange(len(own)) + seen.get(v, 0)
                seen[v] = seen.get(v, 0) + len(own)
            more = [pa.array(np.full(len(value), part, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = materialise(dealt.mapInArrow(run, f"{fields}, _part int, _at long"), "numbered")
    sizes = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = rows.join(begins, [group, "_part"])
    return out.select(*df.columns, (F.col("_from") + F.col("_at")).alias(name))
