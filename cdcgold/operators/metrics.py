"""Latency, lag and catch-up reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cdcgold.operators.views import first_slices
from cdcgold.session import materialise

# The percentiles every report shows.
PERCENTILES = (50, 95, 99)


def nearest_rank(
    df: DataFrame, group: Sequence[str], value: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """Exact nearest-rank percentiles: element ceil(p/100*n) of the sorted values, per group.

    ``percentile_disc`` keeps every distinct value of a group in one task's memory.  Here
    equal values are counted first and dealt to tasks by ranges of (group, value), so a large
    group spreads over many; ranks run within the few tasks that hold a wanted one, offset by
    the counts of the tasks before.
    """
    group = list(group)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    dealt = counted.repartitionByRange(*group, "_v").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "dealt-values")
    sizes = dealt.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))  # a row per group and task
    running = Window.partitionBy(*group).orderBy("_part")
    upto = F.sum("_size").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_size").over(Window.partitionBy(*group))
    # integer arithmetic of ceil(p * n / 100); a task's part is kept only if a wanted rank is in it
    wanted = F.array(
        *(F.struct(F.lit(p).alias("p"), F.expr(f"({p} * _total + 99) div 100").alias("rank")) for p in percentiles)
    )
    inside = F.filter(wanted, lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_size")))
    targets = sizes.withColumns({"_before": upto - F.col("_size"), "_total": total})
    targets = targets.select(*group, "_part", "_before", inside.alias("_wanted")).where(F.size("_wanted") > 0)
    within = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = dealt.join(targets, [*group, "_part"]).withColumn(
        "_upto", F.sum("_n").over(within) + F.col("_before")
    )
    hits = ranked.withColumn("_w", F.explode("_wanted")).where(
        (F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("_n"))
    )
    picked = [F.max(F.when(F.col("_w.p") == p, F.col("_v"))).alias(f"p{p}") for p in percentiles]
    return hits.groupBy(*group).agg(*picked)


def latency_report(
    df: DataFrame, group: Sequence[str], value: str, error: Column, duration: float
) -> DataFrame:
    """Requests, errors, throughput over ``duration`` seconds, percentiles and maximum."""
    totals = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(error).alias("errors"),
        F.max(value).alias("max"),
    )
    rate = F.round(F.col("total").cast("decimal(20,0)") / F.lit(duration).cast("decimal(20,3)"), 1)
    report = totals.withColumn("throughput", rate)
    percentiles = nearest_rank(df, group, value)
    return report.join(percentiles, list(group), "left")


def sync_lag(audit: DataFrame, ledger: DataFrame) -> DataFrame:
    """Milliseconds from source change to bronze and to gold, per change.

    ``audit`` rows carry the batch that took them in and ``__source_ts_ms``; ``ledger`` has
    ``bronze_ms`` and ``gold_ms``, when the writes became visible, once per batch or, as the
    streaming engine keeps it, per batch and log partition.
    """
    on = [c for c in ("topic", "partition", "batch_id") if c in ledger.columns and c in audit.columns]
    joined = audit.join(ledger.select(*on, "bronze_ms", "gold_ms"), on, "left")
    source = F.col("__source_ts_ms")
    return joined.withColumn("bronze_lag_ms", F.col("bronze_ms") - source).withColumn(
        "gold_lag_ms", F.col("gold_ms") - source
    )


def catch_up(log: DataFrame, ledger: DataFrame, restart_ms: int | Column) -> DataFrame:
    """Per log partition: its end, how far gold is, and when it had everything.

    ``ledger``: topic, partition, batch_id, end_offset, gold_ms.  The last record being
    visible implies all earlier ones are, since a partition is applied in order.
    """
    keys = ["topic", "partition"]
    ends = log.groupBy(*keys).agg(F.max("offset").alias("end_offset"))
    applied = ledger.groupBy(*keys).agg(F.max("end_offset").alias("applied_offset"))
    at_end = (
        ledger.withColumnRenamed("end_offset", "_upto")
        .join(ends, keys)
        .where(F.col("_upto") >= F.col("end_offset"))
        .groupBy(*keys)
        .agg(F.min("gold_ms").alias("_done_ms"))
    )
    restart = restart_ms if isinstance(restart_ms, Column) else F.lit(restart_ms)
    joined = ends.join(applied, keys, "left").join(at_end, keys, "left")
    backlog = F.col("end_offset") - F.coalesce(F.col("applied_offset"), F.lit(-1))
    return joined.select(
        *keys,
        "end_offset",
        "applied_offset",
        F.greatest(backlog, F.lit(0)).alias("backlog"),
        F.col("_done_ms").isNotNull().alias("caught_up"),
        (F.col("_done_ms") - restart).alias("catch_up_ms"),
    )


def staleness(reads: DataFrame, docs: DataFrame, key: str, read_ms: str, updated_ms: str) -> DataFrame:
    """Age of the document at each read; null when the key has none.

    Reads are joined to the one document of their key, so a key that is read very often is
    a skewed side the optimizer may split.
    """
    versions = first_slices(docs).select(key, F.col(updated_ms).alias("_updated"))
    joined = reads.join(versions, key, "left")
    return joined.withColumn("age_ms", F.col(read_ms) - F.col("_updated")).drop("_updated")
