"""Latency, lag, catch-up and staleness reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.functions.values import millis
from cdcgold.operators import metrics
from cdcgold.plans.registry import query
from cdcgold.plans.shop import DELETED_EVENT, LOG_SQL, load, pref_log

BATCH = 1000

_CENTS = "CAST(round({} * 100) AS BIGINT)"
_REPORT_SQL = f"""
SELECT {{group}} AS mode, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors,
       CAST(round(count(*) * 10 / 60.0) AS BIGINT) AS throughput_x10,
       {_CENTS.format('quantile_disc(value, 0.5)')} AS p50, {_CENTS.format('quantile_disc(value, 0.95)')} AS p95,
       {_CENTS.format('quantile_disc(value, 0.99)')} AS p99, {_CENTS.format('max(value)')} AS max
FROM events GROUP BY 1
"""


def _report(requests):
    report = metrics.latency_report(requests, ["mode"], "value", F.col("event_type") == DELETED_EVENT, 60)
    values = [F.round(F.col(c) * 100).cast("bigint").alias(c) for c in ("p50", "p95", "p99", "max")]
    return report.select(
        "mode", "total", "errors", (F.col("throughput") * 10).cast("bigint").alias("throughput_x10"), *values
    )


@query(_REPORT_SQL.format(group="event_type"))
def latency_report(spark, directory):
    return _report(load(spark, directory, "events").withColumn("mode", F.col("event_type")))


@query(_REPORT_SQL.format(group="'all'"))
def latency_report_overall(spark, directory):
    return _report(load(spark, directory, "events").withColumn("mode", F.lit("all")))


def audit(spark, directory):
    """The log with the batch that took each record in."""
    log = pref_log(spark, directory)
    return log.withColumn("batch_id", F.expr(f"offset div {BATCH}"))


def ledger(spark, directory):
    """When each batch became visible: after its last change, by a fixed delay per layer."""
    last = audit(spark, directory).groupBy("batch_id").agg(F.max("__source_ts_ms").alias("_last"))
    return last.select("batch_id", (F.col("_last") + 250).alias("bronze_ms"), (F.col("_last") + 900).alias("gold_ms"))


_LAG_SQL = f"""
WITH {LOG_SQL},
batches AS (SELECT event_id // {BATCH} AS batch_id, max(epoch_us(ts) // 1000) AS last_ms FROM log GROUP BY 1),
lags AS (
  SELECT event_id AS pos, last_ms + 250 - (epoch_us(ts) // 1000) AS bronze_lag_ms, last_ms + 900 - (epoch_us(ts) // 1000) AS gold_lag_ms
  FROM log JOIN batches ON batch_id = event_id // {BATCH}
)"""


@query(f"{_LAG_SQL} SELECT pos, bronze_lag_ms, gold_lag_ms FROM lags")
def sync_lag(spark, directory):
    lags = metrics.sync_lag(audit(spark, directory), ledger(spark, directory))
    return lags.select(F.col("offset").alias("pos"), "bronze_lag_ms", "gold_lag_ms")


@query(
    f"""{_LAG_SQL}
    SELECT layer, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
    FROM (SELECT 'bronze' AS layer, bronze_lag_ms AS ms FROM lags UNION ALL SELECT 'gold', gold_lag_ms FROM lags)
    GROUP BY layer
    """
)
def sync_lag_report(spark, directory):
    lags = metrics.sync_lag(audit(spark, directory), ledger(spark, directory))
    pairs = F.array(
        F.struct(F.lit("bronze").alias("layer"), F.col("bronze_lag_ms").alias("ms")),
        F.struct(F.lit("gold").alias("layer"), F.col("gold_lag_ms").alias("ms")),
    )
    return metrics.nearest_rank(lags.select(F.inline(pairs)), ["layer"], "ms")


@query(
    f"""WITH {LOG_SQL},
    rows AS (SELECT CAST(k % 4 AS INTEGER) AS part, event_id, event_id // {BATCH} AS batch_id, epoch_us(ts) // 1000 AS ms FROM log),
    applied AS (
      SELECT part, batch_id, max(event_id) AS upto, max(ms) + 900 AS gold_ms FROM rows GROUP BY 1, 2
    ),
    kept AS (SELECT * FROM applied WHERE part <> 3 OR batch_id < (SELECT max(batch_id) FROM rows)),
    ends AS (SELECT part, max(event_id) AS end_offset, (SELECT min(ms) FROM rows) AS restart FROM rows GROUP BY 1)
    SELECT e.part, end_offset, max(k.upto) AS applied_offset, end_offset - coalesce(max(k.upto), -1) AS backlog,
           coalesce(max(k.upto) >= end_offset, FALSE) AS caught_up,
           coalesce(min(CASE WHEN k.upto >= end_offset THEN k.gold_ms END) - min(restart), -1) AS catch_up_ms
    FROM ends e LEFT JOIN kept k ON k.part = e.part GROUP BY e.part, end_offset
    """
)
def catch_up(spark, directory):
    log = audit(spark, directory)
    bounds = log.agg(F.min("__source_ts_ms").alias("_restart"), F.max("batch_id").alias("_last_batch"))
    applied = log.groupBy("topic", "partition", "batch_id").agg(
        F.max("offset").alias("end_offset"), (F.max("__source_ts_ms") + 900).alias("gold_ms")
    )
    behind = (F.col("partition") == 3) & (F.col("batch_id") == bounds.select("_last_batch").scalar())
    restart = bounds.select("_restart").scalar()
    report = metrics.catch_up(log, applied.where(~behind), restart)
    return report.select(
        F.col("partition").alias("part"), "end_offset", "applied_offset", "backlog", "caught_up",
        F.coalesce("catch_up_ms", F.lit(-1)).alias("catch_up_ms"),
    )


@query(
    """
    WITH d AS (SELECT user_id, min(epoch_us(ts) // 1000) AS updated_ms FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
    SELECT event_id, coalesce((epoch_us(ts) // 1000) - updated_ms, -1) AS age_ms FROM events LEFT JOIN d USING (user_id)
    """
)
def staleness(spark, directory):
    reads = load(spark, directory, "events").select("event_id", "user_id", millis("ts").alias("read_ms"))
    docs = reads.where(F.col("user_id") % 7 != 0).groupBy("user_id").agg(F.min("read_ms").alias("updated_ms"))
    aged = metrics.staleness(reads, docs, "user_id", "read_ms", "updated_ms")
    return aged.select("event_id", F.coalesce("age_ms", F.lit(-1)).alias("age_ms"))
