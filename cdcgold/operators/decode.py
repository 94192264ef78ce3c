"""From raw log records to typed rows, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.functions.cdc import event_id, operation_name
from cdcgold.operators.latest import POSITION

COORDINATES = ("topic", "partition", "offset", "key")
META_SCHEMA = "__op string, __table string, __source_ts_ms bigint, __deleted string"
_CORRUPT = "_corrupt"


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl


def flat_schema(ddl: str | T.StructType) -> T.StructType:
    """A table's schema plus the metadata of a flattened change event."""
    return T.StructType(schema_of(ddl).fields + schema_of(META_SCHEMA).fields)


def _parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Records with their parsed value in ``_p``, tombstones dropped.

    The parse sits in a one-element explode: a filter on ``_p`` is then applied to its
    result, where a plain column would be parsed again inside the pushed-down filter.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = F.from_json("value", with_corrupt, options)
    return drop_tombstones(raw).withColumn("_p", F.explode(F.array(parsed)))


def _is_poison(parsed: Column) -> Column:
    return parsed.isNull() | parsed[_CORRUPT].isNotNull()


def drop_tombstones(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("value").isNotNull())


def _coordinates(raw: DataFrame) -> list[str]:
    return [c for c in (*COORDINATES, "timestamp", "batch_id") if c in raw.columns]


def decode(raw: DataFrame, table: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split records into typed rows and a dead-letter table.

    A value may be the row itself or wrap it as ``{schema, payload}``.  Both shapes are
    fields of one parse schema, so each record is parsed once.
    """
    row = flat_schema(table)
    taken = set(row.names) & set(POSITION)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of log positions: rename them at capture")
    both = T.StructType([T.StructField("payload", row), *row.fields])
    parsed = _parsed(raw, both)
    wrapped = F.col("_p.payload").isNotNull()
    fields = [
        F.when(wrapped, F.col("_p.payload")[f.name]).otherwise(F.col("_p")[f.name]).alias(f.name)
        for f in row.fields
    ]
    kept = _coordinates(raw)
    good = parsed.where(~_is_poison(F.col("_p"))).select(*kept, *fields)
    return good, _rejects(parsed, kept)


def _rejects(parsed: DataFrame, kept: list[str]) -> DataFrame:
    reason = F.when(F.trim(F.col("value")) == "", "empty value").otherwise("unparseable value")
    return parsed.where(_is_poison(F.col("_p"))).select(*kept, "value", reason.alias("reason"))


def envelope_schema(table: str | T.StructType) -> T.StructType:
    """A change event as captured: both images, operation and source position."""
    image = schema_of(table)
    source = T.StructType.fromDDL("table string, ts_ms bigint, gtid string")
    return T.StructType(
        [
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("op", T.StringType()),
            T.StructField("source", source),
        ]
    )


def parse_envelope(raw: DataFrame, table: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Change envelopes as structs (column ``event``), and the rejects."""
    parsed = _parsed(raw, envelope_schema(table))
    kept = _coordinates(raw)
    names = ("before", "after", "op", "source")
    event = F.struct(*[F.col("_p")[n].alias(n) for n in names]).alias("event")
    good = parsed.where(~_is_poison(F.col("_p"))).select(*kept, event)
    return good, _rejects(parsed, kept)


def flatten_envelope(events: DataFrame) -> DataFrame:
    """After-image columns (before-image of a delete) plus metadata columns."""
    kept = _coordinates(events)
    e = F.col("event")
    image = F.when(e["op"] == "d", e["before"]).otherwise(e["after"])
    flat = events.withColumn("_image", image)
    return flat.select(
        *kept,
        "_image.*",
        e["op"].alias("__op"),
        e["source"]["table"].alias("__table"),
        e["source"]["ts_ms"].alias("__source_ts_ms"),
        F.when(e["op"] == "d", "true").otherwise("false").alias("__deleted"),
    )


def standard_envelope(events: DataFrame, pk: str) -> DataFrame:
    """Change events in the source-neutral layout consumers agree on.

    Events of one source transaction share a correlation id; an event without one stands
    for itself.
    """
    e = F.col("event")
    ident = event_id()
    return events.select(
        ident.alias("event_id"),
        e["source"]["table"].alias("source_table"),
        operation_name(e["op"]).alias("operation_type"),
        F.coalesce(e["after"][pk], e["before"][pk]).cast("string").alias("source_pk"),
        F.timestamp_millis(e["source"]["ts_ms"]).alias("event_time"),
        F.col("offset").alias("sequence"),
        F.to_json(e["before"]).alias("payload_before"),
        F.to_json(e["after"]).alias("payload_after"),
        F.coalesce(e["source"]["gtid"], ident).alias("correlation_id"),
    )


def _sliced(docs: DataFrame) -> bool:
    """Whether the documents were built in more than one slice, as their schema tells."""
    field = next((f for f in docs.schema if f.name == "segments"), None)
    return field is not None and field.metadata.get("slices", 1) > 1


def publish(docs: DataFrame, *key: str) -> DataFrame:
    """Documents as key and JSON value, the shape a topic sink takes.

    One message per key, so that a sink which replaces by key loses nothing: name the key
    columns of a row, which are the document's key, and for sliced documents ``segment`` too.
    A key of several columns is their JSON array.
    """
    if not key or ("segment" not in key and _sliced(docs)):
        raise ValueError("the key of a sliced document is its key and its segment")
    one = F.col(key[0]).cast("string") if len(key) == 1 else F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
    return docs.select(
        one.alias("key"),
        F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"),
    )
