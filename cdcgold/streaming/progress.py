"""Times of batches as the streaming query itself reports them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "batch_id bigint, started_ms bigint, done_ms bigint, n_records bigint"


def _ms(timestamp: str) -> int:
    at = dt.datetime.fromisoformat(timestamp)
    return int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp() * 1000)


def batches(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Start, end and size of the batches that the query has reported; idle triggers are left out.

    A query keeps as many reports as ``spark.sql.streaming.numRecentProgressUpdates`` says (100), so
    that is the bound of this table; longer runs take it more often.
    """
    reports = {}
    for p in query.recentProgress:
        if "addBatch" in p["durationMs"]:
            start = _ms(p["timestamp"])
            reports[p["batchId"]] = (p["batchId"], start, start + p["durationMs"]["triggerExecution"], p["numInputRows"])
    return spark.createDataFrame(list(reports.values()), SCHEMA)


def timed(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """A ledger whose batches were visible when the query had ended them; unreported ones are left out."""
    ends = reports.select("batch_id", F.col("done_ms").alias("gold_ms"))
    return ledger.drop("gold_ms").join(ends, "batch_id")
