"""Conversions between wire values and typed columns, and small report arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(c: str | Column) -> Column:
    """0/1 or boolean, as number or text, to boolean; null counts as false."""
    text = F.lower(_col(c).cast("string"))
    return F.coalesce(text.isin("1", "true"), F.lit(False))


def epoch_date(c: str | Column) -> Column:
    """Days since 1970-01-01 to date."""
    return F.date_from_unix_date(_col(c).cast("int"))


def epoch_timestamp(c: str | Column) -> Column:
    """Milliseconds since 1970-01-01 UTC to timestamp."""
    return F.timestamp_millis(_col(c).cast("bigint"))


def millis(c: str | Column) -> Column:
    return F.unix_millis(_col(c).cast("timestamp"))


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal, in exact arithmetic; 0.0 of nothing."""
    exact = F.round(part.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 1)
    return F.when(total == 0, F.lit(0)).otherwise(exact).cast("decimal(5,1)")


def slot(keys: list[Column], slots: Column) -> Column:
    """Spread keys over 0..slots-1 by digest.

    md5 rather than Spark's own hash, so that any SQL engine computes the same slot.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digest, slots.cast("bigint")).cast("int")
