"""A snapshot read in chunks while the log goes on, without a lock, a gap or a step back.

Each chunk is a key range, read at some moment between two marks: the log position noted before
the read and the one noted after it.  A row of the chunk holds every change up to the low mark; of
those between the marks it may hold some.  So rows with a change between their chunk's marks are
dropped, the log has them anyway, and the rest take their place in the log right behind the high
mark.  Applying the result in order then never puts an older row over a newer one, in whatever
order the chunks were read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.session import materialise

CHUNK, LOW, HIGH = "chunk", "low", "high"
#: Behind ``position``: 0 for rows of the log, 1 for rows of a chunk.
PHASE = "phase"


def read_chunks(
    ranges: Iterable, read: Callable[[object], DataFrame], position: Callable[[], int]
) -> DataFrame:
    """Every range's rows, read one range after the other, with the marks around each read.

    ``position`` gives the log's end; ``read`` the rows of a range (as ``sources.tables`` reads key
    ranges).  Each chunk is written before its high mark is taken.
    """
    parts = []
    for number, one in enumerate(ranges):
        low = position()
        rows = materialise(read(one), "chunk")
        marks = {CHUNK: F.lit(number), LOW: F.lit(low).cast("long"), HIGH: F.lit(position()).cast("long")}
        parts.append(rows.withColumns(marks))
    return reduce(DataFrame.unionByName, parts)


def _inside(log: DataFrame, marks: DataFrame, position: str, keys: Sequence[str]) -> DataFrame:
    """(chunk, keys) of log rows between a chunk's marks, each once.

    Positions are dealt to bins as wide as the widest window, so that a window lies in two bins at
    most and the join is one on equal bins.
    """
    width = F.greatest(F.max(F.col(HIGH) - F.col(LOW)), F.lit(1)).alias("w")
    w = marks.agg(width).first()["w"] or 1
    first, last = F.floor(F.col(LOW) / w), F.floor(F.col(HIGH) / w)
    windows = marks.withColumn("_bin", F.explode(F.sequence(first, last)))
    rows = log.select(*keys, F.col(position).alias("_at"), F.floor(F.col(position) / w).alias("_bin"))
    met = rows.join(windows, "_bin").where((F.col("_at") > F.col(LOW)) & (F.col("_at") <= F.col(HIGH)))
    return met.select(CHUNK, *keys).distinct()


def merge_chunks(log: DataFrame, chunks: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The log with the chunks' rows in their places; apply it in order of (``position``, ``phase``).

    ``chunks`` has rows with chunk, low and high (see ``read_chunks``); columns of the log that it
    lacks are null, but for ``__op`` (r) and ``__deleted`` (false).  The log must reach back to the
    lowest mark.  Rows with a null key are kept: no change can name them.
    """
    marks = materialise(chunks.select(CHUNK, LOW, HIGH).distinct(), "marks")
    changed = materialise(_inside(log, marks, position, keys), "changed-in-window")
    settled = chunks.join(changed, [CHUNK, *keys], "left_anti")
    read = {"__op": F.lit("r"), "__deleted": F.lit("false")}
    read = {c: v for c, v in read.items() if c in log.columns}
    placed = settled.withColumns(read | {position: F.col(HIGH).cast(log.schema[position].dataType), PHASE: F.lit(1)})
    placed = placed.drop(CHUNK, LOW, HIGH)
    return log.withColumn(PHASE, F.lit(0)).unionByName(placed, allowMissingColumns=True)
