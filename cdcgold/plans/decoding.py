"""Raw log records made from the event table, and what decoding makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.functions.cdc import is_deleted, key_text, table_of
from cdcgold.operators import decode as D
from cdcgold.operators.diagnosis import diagnose
from cdcgold.plans.registry import query
from cdcgold.plans.shop import LOG_SQL, TOPIC, load, pref_log
from cdcgold.sources.wire import from_wire

PREF_SCHEMA = "user_id bigint, k bigint, event_type string, value double"
_IMAGE = ("user_id", "k", "event_type")


def raw_records(spark, directory):
    """Flattened rows as JSON values: plain, wrapped, cut short, mistyped, empty or null."""
    log = pref_log(spark, directory)
    row = F.struct("user_id", "k", "event_type", "value", "__op", "__table", "__source_ts_ms", "__deleted")
    n = F.col("offset")
    plain = F.to_json(row)
    wrapped = F.to_json(F.struct(F.lit("s").alias("schema"), row.alias("payload")))
    value = (
        F.when(n % 70 == 1, F.lit(None).cast("string"))
        .when(n % 70 == 2, F.lit(""))
        .when(n % 70 == 3, F.lit('{"user_id": "abc"}'))
        .when(n % 50 == 0, F.substring(plain, F.lit(1), F.length(plain) - 1))
        .when(n % 3 == 0, wrapped)
        .otherwise(plain)
    )
    return log.select(
        "topic",
        "partition",
        "offset",
        F.to_json(F.struct("user_id", "k")).alias("key"),
        value.alias("value"),
        F.timestamp_millis("__source_ts_ms").alias("timestamp"),
    )


_KIND_SQL = """
CASE WHEN event_id % 70 = 1 THEN 'tombstone' WHEN event_id % 70 = 2 THEN 'empty value'
     WHEN event_id % 70 = 3 OR event_id % 50 = 0 THEN 'unparseable value' ELSE 'good' END"""


@query(
    f"""WITH {LOG_SQL}
    SELECT event_id AS pos, user_id, k, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
           CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
           event_type = 'error' AS deleted, epoch_us(ts) // 1000 AS source_ts_ms
    FROM log WHERE {_KIND_SQL} = 'good'
    """
)
def decode_records(spark, directory):
    good, _ = D.decode(raw_records(spark, directory), PREF_SCHEMA)
    return good.select(
        F.col("offset").alias("pos"),
        "user_id",
        "k",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.col("__op").alias("op"),
        is_deleted(good.columns).alias("deleted"),
        F.col("__source_ts_ms").alias("source_ts_ms"),
    )


@query(
    f"""SELECT topic, pos, reason FROM (
      SELECT '{TOPIC}' AS topic, event_id AS pos, {_KIND_SQL} AS reason FROM events
    ) WHERE reason NOT IN ('good', 'tombstone')"""
)
def dead_letters(spark, directory):
    _, rejected = D.decode(raw_records(spark, directory), PREF_SCHEMA)
    return rejected.select("topic", F.col("offset").alias("pos"), "reason")


@query(f"SELECT count(*) AS n FROM events WHERE {_KIND_SQL} <> 'tombstone'")
def tombstones_dropped(spark, directory):
    return D.drop_tombstones(raw_records(spark, directory)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS table_name, count(*) AS n FROM events GROUP BY 1")
def route_counts(spark, directory):
    topics = load(spark, directory, "events").select(
        F.concat(F.lit("src.shop."), "event_type").alias("topic")
    )
    return topics.groupBy(table_of("topic").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))


def envelopes(spark, directory):
    """Change envelopes as raw JSON records: both images, operation, source position."""
    log = pref_log(spark, directory)
    image = F.struct(*_IMAGE)
    before = F.when(F.col("__op") != "c", image)
    after = F.when(F.col("__op") != "d", image)
    source = F.struct(
        F.col("__table").alias("table"),
        F.col("__source_ts_ms").alias("ts_ms"),
        F.when(F.col("offset") % 2 == 0, F.concat(F.lit("tx-"), (F.col("offset") / 4).cast("bigint").cast("string"))).alias("gtid"),
    )
    envelope = F.struct(before.alias("before"), after.alias("after"), F.col("__op").alias("op"), source.alias("source"))
    return log.select("topic", "partition", "offset", F.col("k").cast("string").alias("key"), F.to_json(envelope).alias("value"))


@query(
    f"""WITH {LOG_SQL}
    SELECT event_id AS pos, user_id, k, event_type, 'pref' AS table_name, epoch_us(ts) // 1000 AS source_ts_ms,
           CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
           CASE event_type WHEN 'error' THEN 'true' ELSE 'false' END AS deleted
    FROM log
    """
)
def envelope_flatten(spark, directory):
    events, _ = D.parse_envelope(envelopes(spark, directory), "user_id bigint, k bigint, event_type string")
    flat = D.flatten_envelope(events)
    return flat.select(
        F.col("offset").alias("pos"),
        *_IMAGE,
        F.col("__table").alias("table_name"),
        F.col("__source_ts_ms").alias("source_ts_ms"),
        F.col("__op").alias("op"),
        F.col("__deleted").alias("deleted"),
    )


@query(
    f"""WITH {LOG_SQL}, e AS (
      SELECT *, sha256('{TOPIC}|' || (k % 4) || '|' || event_id) AS id,
             '{{"user_id":' || user_id || ',"k":' || k || ',"event_type":"' || event_type || '"}}' AS image
      FROM log
    )
    SELECT id AS event_id, 'pref' AS source_table,
           CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation_type,
           CAST(k AS VARCHAR) AS source_pk, epoch_us(ts) // 1000 AS event_ms, event_id AS sequence,
           CASE WHEN event_type = 'signup' THEN '' ELSE image END AS payload_before,
           CASE WHEN event_type = 'error' THEN '' ELSE image END AS payload_after,
           CASE WHEN event_id % 2 = 0 THEN 'tx-' || (event_id // 4) ELSE id END AS correlation_id
    FROM e
    """
)
def standard_envelope(spark, directory):
    events, _ = D.parse_envelope(envelopes(spark, directory), "user_id bigint, k bigint, event_type string")
    out = D.standard_envelope(events, "k")
    return out.select(
        "event_id",
        "source_table",
        "operation_type",
        "source_pk",
        F.unix_millis("event_time").alias("event_ms"),
        "sequence",
        F.coalesce("payload_before", F.lit("")).alias("payload_before"),
        F.coalesce("payload_after", F.lit("")).alias("payload_after"),
        "correlation_id",
    )


@query(
    """
    SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(ts) // 1000 AS ms, event_id % 2 = 1 AS flagged
    FROM events
    """
)
def typed_values(spark, directory):
    log = pref_log(spark, directory)
    wire = log.select(
        F.col("offset").alias("event_id"),
        F.expr("__source_ts_ms div 86400000").cast("int").alias("day"),
        F.col("__source_ts_ms").alias("at"),
        (F.col("offset") % 2).cast("string").alias("flagged"),
    )
    typed = from_wire(wire, "event_id bigint, day date, at timestamp, flagged boolean")
    return typed.select("event_id", F.col("day").cast("string").alias("day"), F.unix_millis("at").alias("ms"), "flagged")


@query(
    f"""WITH {LOG_SQL}
    SELECT event_id, user_id || ' ' || event_type AS joined, lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded,
           split_part('src.shop.' || event_type, '.', 3) AS last_part, left(md5(event_type), 8) AS prefix,
           lower(event_type) = lower('SIGNUP') AS same_text, event_type IN ('signup', 'error') AS listed,
           CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high,
           event_id * 30 // 100 AS part, CAST(k AS VARCHAR) AS parsed, coalesce(nullif(k, 7), -1) AS filled,
           '{{"k":' || k || '}}' AS written, sha256('e|' || event_id) AS ident
    FROM log
    """
)
def scalar_values(spark, directory):
    """Text, arithmetic, JSON and null handling as the engine's reports and keys use them."""
    log = pref_log(spark, directory)
    topic = F.concat(F.lit("src.shop."), "event_type")
    return log.select(
        F.col("offset").alias("event_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(" "), "event_type").alias("joined"),
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("padded"),
        table_of(topic).alias("last_part"),
        F.substring(F.md5("event_type"), 1, 8).alias("prefix"),
        (F.lower("event_type") == F.lower(F.lit("SIGNUP"))).alias("same_text"),
        F.col("event_type").isin("signup", "error").alias("listed"),
        F.floor("value").alias("low"),
        F.ceil("value").alias("high"),
        F.expr("offset * 30 div 100").alias("part"),
        key_text("k").alias("parsed"),
        F.coalesce(F.nullif("k", F.lit(7)), F.lit(-1)).alias("filled"),
        F.to_json(F.struct("k")).alias("written"),
        F.sha2(F.concat_ws("|", F.lit("e"), F.col("offset").cast("string")), 256).alias("ident"),
    )


@query(
    f"""SELECT '{TOPIC}' AS topic, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS INTEGER) AS part,
        count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_pos FROM events GROUP BY 1, 2"""
)
def audit_log_dedup(spark, directory):
    """A log delivered twice, read back once per coordinate."""
    raw = raw_records(spark, directory)
    twice = raw.unionByName(raw)
    once = twice.dropDuplicates(["topic", "partition", "offset"])
    return once.groupBy("topic", F.col("partition").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_pos")
    )


@query(
    f"""SELECT topic, reason, field, detail, count(*) AS n FROM (
      SELECT '{TOPIC}' AS topic, 'empty value' AS reason, NULL AS field, NULL AS detail FROM events WHERE event_id % 60 = 1
      UNION ALL SELECT '{TOPIC}', 'not json', NULL, NULL FROM events WHERE event_id % 60 = 2
      UNION ALL SELECT '{TOPIC}', 'not an object', NULL, 'array' FROM events WHERE event_id % 60 = 3
      UNION ALL SELECT '{TOPIC}', 'wrong type', 'user_id', 'bigint expected, string' FROM events WHERE event_id % 60 = 4
      UNION ALL SELECT '{TOPIC}', 'wrong type', 'value', 'double expected, boolean' FROM events WHERE event_id % 60 = 4
      UNION ALL SELECT '{TOPIC}', 'missing key', unnest(['user_id', 'k']), NULL FROM events WHERE event_id % 60 = 5
      UNION ALL SELECT 'src.shop.other', 'unknown table', NULL, 'src.shop.other' FROM events WHERE event_id % 60 = 6
    ) GROUP BY ALL
    """
)
def dead_letters_explained(spark, directory):
    """Records damaged in six ways, each finding with its field and what it holds."""
    records = raw_records(spark, directory)
    n = F.col("offset") % 60
    plain = F.get_json_object("key", "$.k")
    value = (
        F.when(n == 1, " ").when(n == 2, '{"user_id": 1').when(n == 3, "[1, 2]")
        .when(n == 4, F.concat(F.lit('{"payload": {"user_id": "x", "value": true, "k": '), plain, F.lit("}}")))
        .when(n == 5, '{"event_type": "view", "k": null}')
        .when(n != 7, F.concat(F.lit('{"user_id": 5, "value": 1.5, "k": '), plain, F.lit("}")))
    )
    topic = F.when(n == 6, "src.shop.other").otherwise(F.col("topic"))
    damaged = records.withColumns({"value": value, "topic": topic})
    found = diagnose(damaged, {"pref": PREF_SCHEMA}, {"pref": ("user_id", "k")})
    return found.groupBy("topic", "reason", "field", "detail").agg(F.count(F.lit(1)).alias("n"))
