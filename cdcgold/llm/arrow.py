"""Arrow batches in and out of Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from cdcgold.llm.text import SLICE_BYTES, slices

_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch sent to Python, unless the cluster sets another number.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The rows, for Python to get as batches of few whole texts.

    A task holds a batch outside its heap, rounded up to a power of two and twice while it
    grows; with Spark's 10,000 rows that is over 100 MB a task, which stays with the process.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, BATCH_ROWS)
    return df


def add_columns(
    df: DataFrame,
    of: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    schema: str,
    text: str,
    keep: Sequence[str],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Rows with the columns `keep` and those that `of` makes from each slice of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            made = of(part)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(made.values()), [*keep, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in [df.schema[c]]]
    return small_batches(df).mapInArrow(run, ", ".join([*fields, schema]))


def keep_rows(
    df: DataFrame, passes: Callable[[pa.RecordBatch], pa.Array], text: str, limit: int = SLICE_BYTES
) -> DataFrame:
    """The rows, with all their columns, for which `passes` says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            yield part.filter(passes(part))

    return small_batches(df).mapInArrow(run, df.schema)
