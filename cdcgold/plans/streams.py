"""Streaming builds over the event table, run to the end of the given data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.operators.decode import decode
from cdcgold.operators.fold import build_profiles
from cdcgold.operators.latest import latest, live
from cdcgold.operators.metrics import catch_up, sync_lag
from cdcgold.plans.decoding import _KIND_SQL, PREF_SCHEMA, raw_records
from cdcgold.plans.registry import query
from cdcgold.plans.shop import (
    LOG_SQL,
    PREFS,
    SHOP,
    TOPIC,
    load,
    pref_log,
    root_snapshot,
    slot_sql,
    text_of,
)
from cdcgold.session import materialise, settings, workspace
from cdcgold.sources.topics import once, stream_files
from cdcgold.spec import ChildSpec
from cdcgold.streaming.counted import NewestView, by_edge, by_field
from cdcgold.streaming.feed import ChangeApplier
from cdcgold.streaming.incremental import IncrementalProfiles
from cdcgold.streaming.keyed import KeyedTable
from cdcgold.streaming.progress import batches, timed
from cdcgold.streaming.stateful import ROCKSDB, changed_elements, documents_of, elements_table

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_mktsegment string"
CUSTOMER_TOPIC = "src.shop.customer"
SCHEMAS = {"customer": CUSTOMER_SCHEMA, "pref": PREF_SCHEMA}
STREAMED = SHOP.with_(children=(PREFS,))
PARTS = 3
#: Records of a landed file, about.
FILE_ROWS = 1 << 16


def customer_records(spark, directory):
    """The customer table as snapshot records."""
    row = F.struct(
        "c_custkey", "c_name", "c_mktsegment", F.lit("r").alias("__op"), F.lit("customer").alias("__table"),
        F.lit(0).alias("__source_ts_ms"), F.lit("false").alias("__deleted"),
    )
    return root_snapshot(spark, directory).select(
        F.lit(CUSTOMER_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("c_custkey").alias("offset"),
        F.col("c_custkey").cast("string").alias("key"),
        F.to_json(row).alias("value"),
        F.timestamp_millis(F.lit(0)).alias("timestamp"),
    )


def _end(records):
    return records.agg(F.max("offset") + 1).first()[0]


def _ranges(records, parts=PARTS, end=None):
    """The log cut into consecutive offset ranges, by bounds that a scan can skip row groups by."""
    end = end or _end(records)
    cuts = [-(-end * i // parts) for i in range(parts + 1)]
    return [records.where((F.col("offset") >= a) & (F.col("offset") < b)) for a, b in zip(cuts, cuts[1:])]


def _parts(records):
    """The log in consecutive ranges, and how many files each part is landed as, one micro-batch a part.

    The files grow in number, not in size, and the micro-batches grow in size, not in number.
    """
    end = _end(records)
    return _ranges(records, end=end), max(1, -(-end // (PARTS * FILE_ROWS)))


def _land(records, folder, files):
    """Exactly so many files, so that a trigger of as many takes in the part and nothing else."""
    records.repartition(files, "topic", "partition", "offset").write.mode("append").parquet(folder)


def _landed(spark, directory):
    """A folder of record files: some children come before their roots, then the rest; files a part."""
    folder = workspace(spark, "records")
    (first, *rest), files = _parts(raw_records(spark, directory))
    for part in (first, customer_records(spark, directory), *rest):
        _land(part, folder, files)
    return folder, files


def _run(spark, engine, folder, files, checkpoint):
    records = stream_files(spark, folder, files_per_trigger=files)
    engine.start(records, checkpoint, {"availableNow": True}).awaitTermination()


def _flat(docs, *extra):
    return docs.select(
        "c_custkey", "c_name", *extra, F.size("prefs").cast("bigint").alias("n_prefs"),
        text_of("prefs", "k", "event_type").alias("prefs_text"),
    )


_STREAM_SQL = f"""
WITH {LOG_SQL},
state AS (
  SELECT user_id, k, arg_max(event_type, event_id) AS event_type FROM log WHERE {_KIND_SQL} = 'good' GROUP BY 1, 2
),
p AS (
  SELECT user_id, count(*) AS n, string_agg(k || ':' || event_type, ',' ORDER BY k) AS t
  FROM state WHERE event_type <> 'error' GROUP BY 1
)
SELECT c_custkey, c_name, coalesce(n, 0) AS n_prefs, coalesce(t, '') AS prefs_text
FROM customer LEFT JOIN p ON user_id = c_custkey
"""


@query(_STREAM_SQL)
def stream_fold(spark, directory):
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    _run(spark, engine, *_landed(spark, directory), workspace(spark, "checkpoint"))
    return _flat(engine.documents())


@query(_STREAM_SQL)
def stream_resume(spark, directory):
    """Stopped after the first files; a second run takes up the rest, some of it delivered twice."""
    path, checkpoint, folder = (workspace(spark, n) for n in ("profiles", "checkpoint", "records"))
    (first, *rest), files = _parts(raw_records(spark, directory))
    for part in (first, customer_records(spark, directory)):
        _land(part, folder, files)
    _run(spark, IncrementalProfiles(spark, STREAMED, SCHEMAS, path, buckets=8), folder, files, checkpoint)
    for part in (first, *rest):
        _land(part, folder, files)
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, path, buckets=8)
    _run(spark, engine, folder, files, checkpoint)
    engine.compact()
    return _flat(engine.documents())


@query(
    f"""SELECT topic, reason, count(*) AS n FROM (
      SELECT '{TOPIC}' AS topic, {_KIND_SQL} AS reason FROM events
    ) WHERE reason NOT IN ('good', 'tombstone') GROUP BY 1, 2
    UNION ALL SELECT '{TOPIC}', 'audited', count(*) FROM events
    UNION ALL SELECT '{CUSTOMER_TOPIC}', 'audited', count(*) FROM customer
    """
)
def stream_audit_and_dead_letters(spark, directory):
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    records = raw_records(spark, directory).unionByName(customer_records(spark, directory))
    engine.process(records, 0)
    n = F.count(F.lit(1)).alias("n")
    rejected = engine.dead_letters().groupBy("topic", "reason").agg(n)
    audited = engine.audit().groupBy("topic", F.lit("audited").alias("reason")).agg(n)
    return rejected.unionByName(audited)


@query(
    f"""WITH {LOG_SQL},
    state AS (
      SELECT k, arg_max(user_id, event_id) AS user_id, arg_max(event_type, event_id) AS event_type
      FROM log WHERE {_KIND_SQL} = 'good' GROUP BY 1
    )
    SELECT k, user_id, event_type FROM state WHERE event_type <> 'error'
    """
)
def bronze_current(spark, directory):
    """One bronze row per primary key, however often the child moved between parents."""
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    engine.process(raw_records(spark, directory).unionByName(customer_records(spark, directory)), 0)
    return engine.bronze_current("pref").select("k", "user_id", "event_type")


@query(_STREAM_SQL)
def stream_seeded(spark, directory):
    """Half of the log bulk-loaded as current rows, then all of it replayed as changes."""
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    log = decode(raw_records(spark, directory), SCHEMAS["pref"])[0]
    half = log.where(F.col("offset") % 2 == 0)
    seeded = materialise(live(latest(half, ["user_id", "k"])).select("user_id", "k", "event_type", "value"), "seeded")
    for _ in range(2):
        engine.seed({"customer": load(spark, directory, "customer"), "pref": seeded})
    _run(spark, engine, *_landed(spark, directory), workspace(spark, "checkpoint"))
    return _flat(engine.documents())


@query(
    f"""SELECT '{TOPIC}' AS topic, count(*) AS n_records, CAST(0 AS BIGINT) AS n_unseen FROM events
    UNION ALL SELECT '{CUSTOMER_TOPIC}', count(*), CAST(0 AS BIGINT) FROM customer
    """
)
def stream_sync_lag(spark, directory):
    """One row of lag per audited record, from the engine's own audit and ledger."""
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    for i, part in enumerate(_ranges(raw_records(spark, directory), 2)):
        engine.process(part.unionByName(customer_records(spark, directory)) if i == 0 else part, i)
    lag = sync_lag(engine.timed_audit(), engine.ledger())
    unseen = F.col("gold_ms").isNull() | (F.col("__source_ts_ms").isNotNull() & F.col("gold_lag_ms").isNull())
    return lag.groupBy("topic").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(unseen).alias("n_unseen"))


@query(
    f"""WITH {LOG_SQL},
    ends AS (
      SELECT '{TOPIC}' AS topic, CAST(k % 4 AS INTEGER) AS part, max(event_id) AS end_offset FROM log GROUP BY 2
      UNION ALL SELECT '{CUSTOMER_TOPIC}', CAST(0 AS INTEGER), max(c_custkey) FROM customer
    )
    SELECT topic, part, end_offset, end_offset AS applied_offset, CAST(0 AS BIGINT) AS backlog, TRUE AS caught_up,
           TRUE AS timed FROM ends
    """
)
def stream_catch_up(spark, directory):
    """A stream with a trigger of its own, caught up by the times that it reports itself."""
    engine = IncrementalProfiles(spark, STREAMED, SCHEMAS, workspace(spark, "profiles"), buckets=8)
    folder, files = _landed(spark, directory)
    records = stream_files(spark, folder, files_per_trigger=8 * files)
    query = engine.start(records, workspace(spark, "checkpoint"), {"processingTime": "1 second"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    reports = batches(spark, query)
    restart = reports.agg(F.min("started_ms")).first()[0]
    report = catch_up(engine.audit(), timed(engine.ledger(), reports), restart)
    return report.select(
        "topic", F.col("partition").alias("part"), "end_offset", "applied_offset", "backlog", "caught_up",
        (F.col("catch_up_ms") >= 0).alias("timed"),
    )


TIE_TOPIC, TIES = "src.shop.tie", ChildSpec("tie", "t", "user_id", "ties", ("t",), other_fk="k")
TIE_SCHEMA = "t bigint, user_id bigint, k bigint, event_type string"
TIED = SHOP.with_(children=(TIES,), direction="both", reparent="move")


def tie_records(spark, directory):
    """Events as changes of a few hundred edges, whose two ends are other customers each time."""
    log = pref_log(spark, directory).withColumn("t", F.col("offset") % 397)
    row = F.struct("t", "user_id", "k", "event_type", "__op", "__deleted")
    return log.select(
        F.lit(TIE_TOPIC).alias("topic"), F.pmod("t", F.lit(4)).cast("int").alias("partition"), "offset",
        F.col("t").cast("string").alias("key"), F.to_json(row).alias("value"),
        F.timestamp_millis("__source_ts_ms").alias("timestamp"),
    )


@query(
    f"""WITH {LOG_SQL},
    state AS (
      SELECT event_id % 397 AS t, arg_max(user_id, event_id) AS a, arg_max(k, event_id) AS b,
             arg_max(event_type, event_id) AS event_type
      FROM log GROUP BY 1
    ),
    ends AS (
      SELECT a AS c_custkey, t FROM state WHERE event_type <> 'error'
      UNION SELECT b, t FROM state WHERE event_type <> 'error'
    ),
    folded AS (SELECT c_custkey, count(*) AS n, string_agg(t::VARCHAR, ',' ORDER BY t) AS ties FROM ends GROUP BY 1)
    SELECT c_custkey, c_name, coalesce(n, 0) AS n_ties, coalesce(ties, '') AS ties_text
    FROM customer LEFT JOIN folded USING (c_custkey)
    """
)
def stream_fold_both(spark, directory):
    """Edges kept with both their ends while the ends change, from the reverse index."""
    schemas = {"customer": CUSTOMER_SCHEMA, "tie": TIE_SCHEMA}
    engine = IncrementalProfiles(spark, TIED, schemas, workspace(spark, "profiles"), buckets=8)
    folder = workspace(spark, "records")
    (first, *rest), files = _parts(tie_records(spark, directory))
    for part in (first, customer_records(spark, directory), *rest):
        _land(part, folder, files)
    _run(spark, engine, folder, files, workspace(spark, "checkpoint"))
    return engine.documents().select(
        "c_custkey", "c_name", F.size("ties").cast("bigint").alias("n_ties"), text_of("ties", "t").alias("ties_text")
    )


ROOT_SCHEMA = f"{CUSTOMER_SCHEMA}, updated_ms bigint"
ONE_ENDED = ChildSpec("tie", "t", "user_id", "ties", ("t", "k"))
CHANGING = SHOP.with_(children=(ONE_ENDED,), root_delete="drop", reparent="move")
NEWEST = 50


def root_records(spark, directory):
    """Events as changes of their users: the kind of event is the status, an error deletes the user."""
    log = pref_log(spark, directory)
    row = F.struct(
        F.col("user_id").alias("c_custkey"), F.concat(F.lit("user-"), "user_id").alias("c_name"),
        F.col("event_type").alias("c_mktsegment"), F.col("__source_ts_ms").alias("updated_ms"), "__op", "__deleted",
    )
    return log.select(
        F.lit(CUSTOMER_TOPIC).alias("topic"), F.lit(0).alias("partition"), "offset",
        F.col("user_id").cast("string").alias("key"), F.to_json(row).alias("value"),
        F.timestamp_millis("__source_ts_ms").alias("timestamp"),
    )


def _with_views(spark, directory, *views):
    """Users and edges that change, move and go in every batch, with views kept beside the documents."""
    schemas = {"customer": ROOT_SCHEMA, "tie": TIE_SCHEMA}
    engine = IncrementalProfiles(spark, CHANGING, schemas, workspace(spark, "profiles"), buckets=8, views=views)
    folder = workspace(spark, "records")
    parts, files = _parts(root_records(spark, directory).unionByName(tie_records(spark, directory)))
    for part in parts:
        _land(part, folder, 2 * files)  # two records an event
    _run(spark, engine, folder, 2 * files, workspace(spark, "checkpoint"))
    return engine


_VIEWED_SQL = f"""
WITH {LOG_SQL},
users AS (
  SELECT user_id AS c_custkey, arg_max(event_type, event_id) AS status, arg_max(epoch_us(ts) // 1000, event_id) AS updated_ms
  FROM log GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'
),
ties AS (
  SELECT event_id % 397 AS t, arg_max(user_id, event_id) AS c_custkey, arg_max(k, event_id) AS k
  FROM log GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'
)"""


@query(f"{_VIEWED_SQL} SELECT status AS c_mktsegment, count(*) AS n FROM users GROUP BY 1")
def stream_status_counts(spark, directory):
    """Documents by status, kept by what each batch adds and takes off."""
    view = by_field(spark, workspace(spark, "view"), "c_mktsegment", buckets=2)
    _with_views(spark, directory, view)
    return view.counts()


@query(f"{_VIEWED_SQL} SELECT k, c_custkey, count(*) AS n FROM ties JOIN users USING (c_custkey) GROUP BY 1, 2")
def stream_reverse_edges(spark, directory):
    """Documents by the ends of their edges, kept while edges move between documents and documents go."""
    view = by_edge(spark, workspace(spark, "view"), "c_custkey", "ties", "k", buckets=8)
    _with_views(spark, directory, view)
    return view.counts()


@query(
    f"""{_VIEWED_SQL},
    n AS (SELECT c_custkey, count(*) AS n, string_agg(t::VARCHAR, ',' ORDER BY t) AS ties FROM ties GROUP BY 1)
    SELECT c_custkey, status AS c_mktsegment, coalesce(n, 0) AS n_ties, coalesce(ties, '') AS ties_text
    FROM users LEFT JOIN n USING (c_custkey) ORDER BY updated_ms DESC, c_custkey LIMIT {NEWEST}
    """
)
def stream_newest(spark, directory):
    """The documents changed last: keys from the last days that are needed, documents by their buckets."""
    newest = NewestView(spark, workspace(spark, "view"), "c_custkey", "updated_ms", buckets=8)
    engine = _with_views(spark, directory, *newest.views())
    docs = engine.documents_of(newest.newest(NEWEST).select("c_custkey"))
    return docs.select(
        "c_custkey", "c_mktsegment", F.size("ties").cast("bigint").alias("n_ties"), text_of("ties", "t").alias("ties_text")
    )


_SLICED_SQL = f"""
WITH {LOG_SQL},
state AS (
  SELECT user_id, k, arg_max(event_type, event_id) AS event_type FROM log WHERE {_KIND_SQL} = 'good' GROUP BY 1, 2
),
p AS (
  SELECT user_id, {slot_sql('CAST(k AS VARCHAR)', '2')} AS segment, count(*) AS n,
         string_agg(k || ':' || event_type, ',' ORDER BY k) AS t
  FROM state WHERE event_type <> 'error' GROUP BY 1, 2
)
SELECT c_custkey, c_name, CAST(s AS INTEGER) AS segment, coalesce(n, 0) AS n_prefs, coalesce(t, '') AS prefs_text
FROM customer JOIN range(2) slices(s) ON TRUE LEFT JOIN p ON user_id = c_custkey AND segment = s
"""


@query(_SLICED_SQL)
def stream_fold_state(spark, directory):
    (folder, files), checkpoint = _landed(spark, directory), workspace(spark, "checkpoint")
    records = stream_files(spark, folder, files_per_trigger=files)
    topics = {"customer": CUSTOMER_TOPIC, "pref": TOPIC}
    logs = {t: decode(records.where(F.col("topic") == topics[t]), SCHEMAS[t])[0] for t in SCHEMAS}
    partitions = str(spark.sparkContext.defaultParallelism)
    with settings(spark, {**ROCKSDB, "spark.sql.shuffle.partitions": partitions}):
        gold = elements_table(spark, workspace(spark, "elements"), buckets=8)
        writer = changed_elements(STREAMED, logs, slices=2).writeStream.outputMode("update").foreachBatch(gold.append)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _flat(documents_of(STREAMED, SCHEMAS, gold.current(), slices=2), "segment")


@query(
    f"""WITH {LOG_SQL},
    changed AS (
      SELECT user_id, k, max(event_id) AS pos, arg_max(event_type, event_id) AS event_type
      FROM log GROUP BY user_id, k
    ),
    p AS (
      SELECT user_id, count(*) AS n, string_agg(k || ':' || event_type, ',' ORDER BY pos) AS t
      FROM changed WHERE event_type <> 'error' GROUP BY 1
    )
    SELECT c_custkey, c_name, coalesce(n, 0) AS n_prefs, coalesce(t, '') AS prefs_text
    FROM customer LEFT JOIN p ON user_id = c_custkey
    """
)
def stream_change_apply(spark, directory):
    """Changes patched into existing documents; a changed element moves to the end."""
    log = pref_log(spark, directory)
    docs = build_profiles(STREAMED, {"customer": root_snapshot(spark, directory), "pref": log.limit(0)})
    gold = KeyedTable(spark, workspace(spark, "gold"), docs.schema, ["c_custkey"], by="c_custkey", whole=True, buckets=8)
    gold.append(docs, -1)
    folder = workspace(spark, "changes")
    changes = log.select("offset", "user_id", "k", "event_type", "value", "__op")
    # late parts come first, and each is several files
    for part in reversed(_ranges(changes)):
        part.repartition(4).write.mode("append").parquet(folder)

    def feed(batch):
        return batch.select(
            F.col("user_id").alias("c_custkey"),
            "k",
            "event_type",
            "value",
            F.when(F.col("__op") == "d", "delete").otherwise("update").alias("operation"),
            F.col("offset").alias("pos"),
        )

    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    applier = ChangeApplier(gold, "c_custkey", [PREFS], {"prefs": feed}, ["pos"])
    applier.start(stream, workspace(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return _flat(gold.current())


@query(
    f"""WITH {LOG_SQL},
    last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM log GROUP BY 1),
    n AS (
      SELECT user_id, count(*) AS n FROM (
        SELECT user_id, k, arg_max(event_type, event_id) AS event_type FROM log GROUP BY 1, 2
      ) WHERE event_type <> 'error' GROUP BY 1
    )
    SELECT c_custkey, c_name,
           CASE WHEN last.event_type = 'error' THEN 'DELETED'
                WHEN last.event_type IS NOT NULL THEN last.event_type ELSE c_mktsegment END AS c_mktsegment,
           coalesce(n, 0) AS n_prefs
    FROM customer LEFT JOIN last ON last.user_id = c_custkey LEFT JOIN n ON n.user_id = c_custkey
    """
)
def stream_root_changes(spark, directory):
    """Root patches and soft deletes through the stream beside child changes, parts out of order."""
    log = pref_log(spark, directory)
    docs = build_profiles(STREAMED, {"customer": root_snapshot(spark, directory), "pref": log.limit(0)})
    gold = KeyedTable(spark, workspace(spark, "gold"), docs.schema, ["c_custkey"], by="c_custkey", whole=True, buckets=8)
    gold.append(docs, -1)
    folder = workspace(spark, "changes")
    changes = log.select("offset", "user_id", "k", "event_type", "value", "__op")
    first, second, *rest = _ranges(changes)
    for part in (second, first, *rest):
        part.repartition(3).write.mode("append").parquet(folder)

    def feed(batch):
        operation = F.when(F.col("__op") == "d", "delete").otherwise("update")
        return batch.withColumnsRenamed({"user_id": "c_custkey", "offset": "pos"}).withColumn("operation", operation)

    def root(batch):
        rows = feed(batch).drop("k").withColumn("c_mktsegment", F.col("event_type"))
        return rows.withColumn("c_name", F.concat(F.lit("user-"), "c_custkey"))

    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    applier = ChangeApplier(
        gold, "c_custkey", [PREFS], {"prefs": feed}, ["pos"], root=root,
        set_columns=["c_mktsegment"], set_on_insert=["c_name"], status_field="c_mktsegment",
    )
    applier.start(stream, workspace(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return gold.current().select("c_custkey", "c_name", "c_mktsegment", F.size("prefs").cast("bigint").alias("n_prefs"))


@query(
    f"""SELECT '{TOPIC}' AS topic, k % 4 AS partition, count(*) AS n, sum(event_id)::BIGINT AS offsets
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL"""
)
def stream_once(spark, directory):
    """A third of the log a batch, with repeats inside the time they are remembered, and long after it."""
    log = raw_records(spark, directory).withColumn("timestamp", F.timestamp_seconds(F.col("offset") + 86400))
    (first, second, third), files = _parts(log)
    end = _end(log) - 1
    folder = workspace(spark, "records")
    # the second batch repeats the end of the first; the third also records far behind the watermark
    again = first.where(F.col("offset") > end // 4)
    for part in (first, second.unionByName(again), third.unionByName(again).unionByName(first)):
        _land(part, folder, files)
    table, checkpoint = workspace(spark, "once"), workspace(spark, "checkpoint")
    stream = once(stream_files(spark, folder, files_per_trigger=files), f"{int(0.36 * end)} seconds")
    partitions = str(spark.sparkContext.defaultParallelism)
    with settings(spark, {**ROCKSDB, "spark.sql.shuffle.partitions": partitions}):
        writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(table).groupBy("topic", "partition")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))
