"""Keyed table maintenance and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.operators import changes, merge
from cdcgold.operators.fold import build_profiles
from cdcgold.operators.latest import latest
from cdcgold.plans.registry import query
from cdcgold.plans.shop import (
    LIVE_SQL,
    LOG_SQL,
    PREFS,
    SHOP,
    load,
    pref_log,
    root_log,
    root_snapshot,
    roots_sql,
    shop_tables,
    slot_sql,
    text_of,
)


def _batch(spark, directory, factor=1):
    """The newest event of each user as a replacement root row."""
    newest = latest(root_log(spark, directory), ["c_custkey"])
    return newest.select((F.col("c_custkey") * factor).alias("c_custkey"), "c_name", "c_mktsegment", "__op", "offset")


_BATCH_SQL = """
batch AS (
  SELECT user_id * {factor} AS c_custkey, 'user-' || user_id AS c_name,
         arg_max(event_type, event_id) AS c_mktsegment, max(event_id) AS pos
  FROM events GROUP BY user_id
)"""


@query(
    f"""WITH {_BATCH_SQL.format(factor=13)}
    SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM batch)
    UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM batch
    """
)
def replace_upsert(spark, directory):
    batch = _batch(spark, directory, 13).select("c_custkey", "c_name", "c_mktsegment")
    return merge.replace_upsert(root_snapshot(spark, directory), batch, ["c_custkey"])


@query(
    f"""WITH {_BATCH_SQL.format(factor=13)},
    b AS (
      SELECT c_custkey, CASE WHEN pos % 3 = 0 THEN (SELECT any_value(c.c_name) FROM customer c WHERE c.c_custkey = batch.c_custkey) ELSE c_name END AS c_name,
             CASE WHEN pos % 3 = 0 THEN (SELECT any_value(c.c_mktsegment) FROM customer c WHERE c.c_custkey = batch.c_custkey) ELSE c_mktsegment END AS c_mktsegment
      FROM batch
    )
    SELECT count(*) FILTER (WHERE c.c_custkey IS NULL) AS inserted,
           count(*) FILTER (WHERE c.c_custkey IS NOT NULL AND (c.c_name IS DISTINCT FROM b.c_name OR c.c_mktsegment IS DISTINCT FROM b.c_mktsegment)) AS changed,
           count(*) FILTER (WHERE c.c_custkey IS NOT NULL AND c.c_name IS NOT DISTINCT FROM b.c_name AND c.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment) AS matched
    FROM b LEFT JOIN customer c USING (c_custkey)
    """
)
def upsert_counts(spark, directory):
    target = root_snapshot(spark, directory)
    batch = _batch(spark, directory, 13)
    known = target.select("c_custkey", F.col("c_name").alias("_n"), F.col("c_mktsegment").alias("_m"))
    same = F.col("offset") % 3 == 0
    batch = batch.join(known, "c_custkey", "left").select(
        "c_custkey",
        F.when(same, F.col("_n")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(same, F.col("_m")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return merge.upsert_counts(target, batch, ["c_custkey"])


@query(
    f"""WITH {_BATCH_SQL.format(factor=13)}
    SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey,
           coalesce(c.c_name, b.c_name) AS c_name,
           coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment
    FROM customer c FULL JOIN batch b ON c.c_custkey = b.c_custkey
    """
)
def patch_upsert(spark, directory):
    patch = _batch(spark, directory, 13)
    return merge.patch_upsert(
        root_snapshot(spark, directory), patch, ["c_custkey"], ["c_mktsegment"], ["c_name"]
    )


@query(
    f"""WITH {_BATCH_SQL.format(factor=13)}
    SELECT c.c_custkey, c.c_name,
           CASE WHEN b.c_mktsegment = 'error' THEN 'DELETED' ELSE c.c_mktsegment END AS c_mktsegment
    FROM customer c LEFT JOIN batch b ON c.c_custkey = b.c_custkey
    """
)
def soft_delete(spark, directory):
    deletes = _batch(spark, directory, 13).where(F.col("__op") == "d").select("c_custkey")
    return merge.soft_delete(root_snapshot(spark, directory), deletes, "c_custkey", "c_mktsegment")


def _inserts(spark, directory):
    log = pref_log(spark, directory)
    return log.select(
        (F.col("user_id") * 13).alias("c_custkey"),
        F.concat(F.lit("ref-"), F.col("k").cast("string"), F.lit("-"), "event_type").alias("ref"),
        F.col("offset").alias("pos"),
    )


@query(
    f"""WITH {LOG_SQL}, b AS (
      SELECT user_id * 13 AS c_custkey, arg_min('ref-' || k || '-' || event_type, event_id) AS ref, min(event_id) AS pos
      FROM log GROUP BY 1
    )
    SELECT c_custkey, ref, pos FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
    """
)
def insert_ignore(spark, directory):
    return merge.insert_ignore(
        root_snapshot(spark, directory), _inserts(spark, directory), ["c_custkey"], "pos"
    )


@query(
    f"""WITH RECURSIVE {LOG_SQL.strip()},
    candidate AS (
      SELECT user_id * 13 AS c_custkey, 'ref-' || k || '-' || event_type AS ref, event_id AS pos FROM log
      WHERE user_id * 13 NOT IN (SELECT c_custkey FROM customer)
        AND 'ref-' || k || '-' || event_type NOT IN (SELECT 'ref-' || c_custkey || '-click' FROM customer)
    ),
    step AS (
      SELECT CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS refs
      UNION ALL
      SELECT min(c.pos), list_append(ids, arg_min(c.c_custkey, c.pos)), list_append(refs, arg_min(c.ref, c.pos))
      FROM step s JOIN candidate c
        ON c.pos > s.pos AND NOT list_contains(ids, c.c_custkey) AND NOT list_contains(refs, c.ref)
      GROUP BY ids, refs
    )
    SELECT c_custkey, ref, pos FROM candidate JOIN (SELECT pos FROM step) USING (pos)
    """
)
def insert_ignore_two_keys(spark, directory):
    """The SQL lets in the next row that collides with none before it, one a step."""
    target = root_snapshot(spark, directory).select(
        "c_custkey", F.concat(F.lit("ref-"), F.col("c_custkey").cast("string"), F.lit("-click")).alias("ref")
    )
    return merge.insert_ignore(target, _inserts(spark, directory), ["c_custkey", "ref"], "pos")


_UPDATES_SQL = """
updates AS (
  SELECT user_id AS c_custkey, event_id AS seq, 'v' || event_id AS value,
         CASE WHEN event_type = 'signup' THEN 'c_name' WHEN event_type = 'view' THEN 'other' ELSE 'c_mktsegment' END AS field
  FROM events
),
last AS (
  SELECT c_custkey, max(CASE WHEN field = 'c_name' THEN seq END) AS n,
         max(CASE WHEN field = 'c_mktsegment' THEN seq END) AS m,
         max(CASE WHEN field <> 'other' THEN seq END) AS any_seq
  FROM updates GROUP BY 1
)"""


def updates(spark, directory):
    kind = F.col("event_type")
    field = F.when(kind == "signup", "c_name").when(kind == "view", "other").otherwise("c_mktsegment")
    return load(spark, directory, "events").select(
        F.col("user_id").alias("c_custkey"),
        field.alias("field"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"),
        F.col("event_id").alias("seq"),
    )


@query(
    f"""WITH {_UPDATES_SQL}
    SELECT c.c_custkey, CASE WHEN n IS NOT NULL THEN 'v' || n ELSE c_name END AS c_name,
           CASE WHEN m IS NOT NULL THEN 'v' || m ELSE c_mktsegment END AS c_mktsegment,
           coalesce(any_seq, -1) AS updated_at
    FROM customer c LEFT JOIN last USING (c_custkey)
    """
)
def point_updates(spark, directory):
    target = root_snapshot(spark, directory).withColumn("updated_at", F.lit(-1).cast("bigint"))
    rows = updates(spark, directory).withColumn("updated_at", F.col("seq"))
    return merge.point_updates(target, rows, "c_custkey", ["c_name", "c_mktsegment"], "updated_at")


def _versions(spark, directory):
    old = root_snapshot(spark, directory)
    batch = _batch(spark, directory, 13)
    gone = batch.where(F.col("__op") == "d")
    live = batch.where(F.col("__op") != "d").select(*old.columns)
    new = merge.replace_upsert(old, live, ["c_custkey"]).join(gone, "c_custkey", "left_anti")
    return old, new


@query(
    f"""WITH {_BATCH_SQL.format(factor=13)}
    SELECT b.c_custkey,
           CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN b.c_mktsegment = 'error' THEN 'delete' ELSE 'update' END AS operation,
           coalesce(c.c_name, '') AS before_name,
           CASE WHEN b.c_mktsegment = 'error' THEN '' ELSE b.c_name END AS after_name
    FROM batch b LEFT JOIN customer c ON c.c_custkey = b.c_custkey
    WHERE NOT (c.c_custkey IS NULL AND b.c_mktsegment = 'error')
    """
)
def change_feed(spark, directory):
    old, new = _versions(spark, directory)
    feed = changes.only(changes.diff(old, new, ["c_custkey"]))
    return feed.select(
        "c_custkey",
        "operation",
        F.coalesce("before.c_name", F.lit("")).alias("before_name"),
        F.coalesce("after.c_name", F.lit("")).alias("after_name"),
    )


@query(
    f"""WITH {LIVE_SQL},
    {roots_sql()},
    changed AS (
      SELECT user_id, k, max(event_id) AS pos, arg_max(event_type, event_id) AS event_type
      FROM log GROUP BY user_id, k
    ),
    p AS (
      SELECT c_custkey, segment, count(*) AS n, string_agg(k || ':' || event_type, ',' ORDER BY pos) AS t
      FROM roots JOIN changed ON user_id = c_custkey AND segment = {slot_sql('CAST(k AS VARCHAR)', 'segments')}
      WHERE event_type <> 'error' GROUP BY 1, 2
    )
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment, coalesce(n, 0) AS n_prefs, coalesce(t, '') AS prefs_text
    FROM roots LEFT JOIN p USING (c_custkey, segment)
    """
)
def feed_patches_arrays(spark, directory):
    """Every event patched over documents that hold its outcome; elements end in change order."""
    docs = build_profiles(SHOP, shop_tables(spark, directory))
    feed = pref_log(spark, directory).select(
        F.col("user_id").alias("c_custkey"),
        "k",
        "event_type",
        "value",
        F.when(F.col("__op") == "d", "delete").otherwise("update").alias("operation"),
        F.col("offset").alias("pos"),
    )
    patched = changes.patch_arrays(docs, "c_custkey", PREFS, feed, ["pos"])
    return patched.select(
        "c_custkey",
        "segment",
        F.size("prefs").cast("bigint").alias("n_prefs"),
        text_of("prefs", "k", "event_type").alias("prefs_text"),
    )
