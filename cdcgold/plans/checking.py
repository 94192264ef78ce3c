"""Reconciliation, verification and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.operators import checks, merge
from cdcgold.operators.decode import decode, publish
from cdcgold.operators.flat import assemble, flat_rows
from cdcgold.operators.fold import build_profiles, profiles_from_logs
from cdcgold.operators.latest import latest, live
from cdcgold.operators.parity import Parity, relational_facts
from cdcgold.plans.merges import _UPDATES_SQL, updates
from cdcgold.plans.registry import query
from cdcgold.plans.shop import (
    DELETED_EVENT,
    EVENT_OPS,
    LIVE_SQL,
    LOG_SQL,
    PREFS,
    SHOP,
    TOPIC,
    links,
    live_prefs,
    load,
    pref_log,
    root_snapshot,
    shop_tables,
)
from cdcgold.plans.streams import CUSTOMER_TOPIC, SCHEMAS, customer_records
from cdcgold.session import settings, workspace
from cdcgold.sources.topics import stream_files
from cdcgold.streaming.keyed import KeyedTable
from cdcgold.streaming.stateful import ROCKSDB, fold_stream

_FIELDS = ("c_name", "c_mktsegment")


def _damaged(spark, directory):
    """The customers as a target that lost some rows and fell behind on others."""
    key = F.col("c_custkey")
    status = F.when(key % 13 == 0, "OLD").otherwise(F.col("c_mktsegment"))
    return root_snapshot(spark, directory).where(key % 17 != 0).withColumn("c_mktsegment", status)


_VERDICT_SQL = """
CASE WHEN c_custkey % 17 = 0 THEN 'MISSING' WHEN c_custkey % 13 = 0 THEN 'STALE' ELSE 'OK' END"""


@query(
    f"""SELECT c_custkey, {_VERDICT_SQL} AS verdict,
        CASE WHEN {_VERDICT_SQL} = 'STALE' THEN 'c_mktsegment:' || c_mktsegment || ':OLD' ELSE '' END AS diffs_text
        FROM customer"""
)
def reconcile(spark, directory):
    verdicts = checks.reconcile(root_snapshot(spark, directory), _damaged(spark, directory), "c_custkey", _FIELDS)
    text = F.transform("diffs", lambda d: F.concat_ws(":", d["field"], d["source"], d["target"]))
    return verdicts.select("c_custkey", "verdict", F.array_join(text, ",").alias("diffs_text"))


@query("SELECT c_custkey, 'OK' AS verdict FROM customer")
def reconcile_sliced(spark, directory):
    """One verdict a source row also where the target's documents are several rows each."""
    docs = build_profiles(SHOP.with_(slices=3), shop_tables(spark, directory))
    return checks.reconcile(root_snapshot(spark, directory), docs, "c_custkey", _FIELDS).drop("diffs")


_SUMMARY_SQL = f"""
WITH v AS (SELECT {_VERDICT_SQL} AS verdict FROM ({{rows}})),
n AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'OK') AS ok,
         count(*) FILTER (WHERE verdict = 'STALE') AS stale, count(*) FILTER (WHERE verdict = 'MISSING') AS missing
  FROM v
)
SELECT *, CAST(round(ok * 1000.0 / total) AS BIGINT) AS ok_permille,
       CAST(round(stale * 1000.0 / total) AS BIGINT) AS stale_permille,
       CAST(round(missing * 1000.0 / total) AS BIGINT) AS missing_permille, stale + missing = 0 AS passed
FROM n
"""


def _summary(verdicts):
    out = checks.reconcile_summary(verdicts)
    permille = [(F.col(f"{v}_pct") * 10).cast("bigint").alias(f"{v}_permille") for v in ("ok", "stale", "missing")]
    return out.select("total", "ok", "stale", "missing", *permille, "passed")


@query(_SUMMARY_SQL.format(rows="SELECT c_custkey FROM customer"))
def reconcile_summary(spark, directory):
    return _summary(
        checks.reconcile(root_snapshot(spark, directory), _damaged(spark, directory), "c_custkey", _FIELDS)
    )


@query(_SUMMARY_SQL.format(rows="SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 200"))
def reconcile_first_n(spark, directory):
    return _summary(
        checks.reconcile(
            root_snapshot(spark, directory), _damaged(spark, directory), "c_custkey", _FIELDS, limit=200
        )
    )


@query(
    f"""WITH {_UPDATES_SQL},
    expected AS (
      SELECT c_custkey, field, max(seq) AS seq, 'v' || max(seq) AS expected FROM updates GROUP BY 1, 2
    ),
    docs AS (
      SELECT c.c_custkey, CASE WHEN n IS NOT NULL THEN 'v' || n ELSE c_name END AS c_name,
             CASE WHEN c.c_custkey % 13 = 0 THEN 'OLD' WHEN m IS NOT NULL THEN 'v' || m ELSE c_mktsegment END AS c_mktsegment
      FROM customer c LEFT JOIN last USING (c_custkey) WHERE c.c_custkey % 17 <> 0
    ),
    seen AS (
      SELECT e.*, CASE WHEN d.c_custkey IS NULL THEN 'NOT_FOUND' WHEN field = 'c_name' THEN c_name
                       WHEN field = 'c_mktsegment' THEN c_mktsegment ELSE 'NOT_FOUND' END AS actual
      FROM expected e LEFT JOIN docs d USING (c_custkey)
    )
    SELECT c_custkey, 'UPDATE' AS op, field, expected, actual,
           CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM seen
    """
)
def verify_changes(spark, directory):
    log = updates(spark, directory)
    docs = merge.point_updates(root_snapshot(spark, directory), log, "c_custkey", _FIELDS)
    key = F.col("c_custkey")
    docs = docs.where(key % 17 != 0).withColumn(
        "c_mktsegment", F.when(key % 13 == 0, "OLD").otherwise(F.col("c_mktsegment"))
    )
    expected = log.withColumn("op", F.lit("UPDATE")).withColumnRenamed("value", "expected")
    return checks.verify_changes(expected, docs, "c_custkey", _FIELDS)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 17 = 0")
def missing_rows(spark, directory):
    gone = checks.missing(root_snapshot(spark, directory), _damaged(spark, directory), ["c_custkey"])
    return gone.select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness(spark, directory):
    return checks.duplicates(load(spark, directory, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {LOG_SQL}
    SELECT 'lineitem' AS "table", 'unique' AS rule, 'l_orderkey,l_linenumber' AS "column",
           l_orderkey || '|' || l_linenumber AS value, count(*) AS n_rows
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL
    SELECT 'orders', 'foreign_key', 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
    UNION ALL
    SELECT 'labels', 'foreign_key', 'doc_id', CAST(doc_id AS VARCHAR), count(*) FROM labels
    WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id
    UNION ALL
    SELECT 'link', 'foreign_key', 'from_user', CAST(user_id AS VARCHAR), count(*) FROM log
    WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id
    UNION ALL
    SELECT 'events', 'one_of', 'event_type', event_type, count(*) FROM events
    WHERE event_type NOT IN ('signup', 'click', 'view', 'purchase') GROUP BY event_type
    UNION ALL
    SELECT 'label of document', 'not_null', 'quality', 'null', count(*) FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NULL HAVING count(*) > 0
    """
)
def constraints(spark, directory):
    names = ("lineitem", "orders", "customer", "labels", "documents", "supplier", "events")
    tables = {t: load(spark, directory, t) for t in names}
    tables["link"] = links(spark, directory)
    tables["label of document"] = tables["documents"].select("doc_id").join(tables["labels"], "doc_id", "left")
    kinds = tuple(k for k in EVENT_OPS if k != DELETED_EVENT)
    return checks.violations(
        tables,
        [
            checks.Unique("lineitem", ("l_orderkey", "l_linenumber")),
            checks.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
            checks.ForeignKey("labels", "doc_id", "documents", "doc_id"),
            checks.ForeignKey("link", "from_user", "supplier", "s_suppkey"),
            checks.OneOf("events", "event_type", kinds),
            checks.NotNull("label of document", "quality"),
        ],
    )


@query(
    """
    SELECT field, CAST(0 AS BIGINT) AS bronze_lacking, CAST(0 AS BIGINT) AS gold_leaking
    FROM (VALUES ('__op'), ('__table'), ('__source_ts_ms'), ('__deleted')) t(field)
    """
)
def layer_hygiene(spark, directory):
    bronze = latest(pref_log(spark, directory), ["user_id", "k"])
    tables = {**shop_tables(spark, directory), "pref": live(bronze)}
    gold = publish(build_profiles(SHOP, tables), "c_custkey")
    return checks.layer_hygiene(bronze, gold)


@query(
    f"""WITH {LOG_SQL},
    state AS (SELECT user_id, k, max(event_id) AS pos FROM log GROUP BY 1, 2),
    c AS (SELECT count(*) AS n, count(*) FILTER (pos % 5 <> 0) AS few FROM state),
    g AS (SELECT count(*) FILTER (c_custkey % 3 = 0) AS few FROM customer)
    SELECT field, CASE field WHEN '__op' THEN c.few WHEN '__table' THEN c.n ELSE 0 END AS bronze_lacking,
           CASE field WHEN '__deleted' THEN g.few ELSE 0 END AS gold_leaking
    FROM (VALUES ('__op'), ('__table'), ('__source_ts_ms'), ('__deleted')) t(field), c, g
    """
)
def layer_hygiene_damaged(spark, directory):
    """Bronze without one field and with gaps in another, and documents that leak a third."""
    bronze = latest(pref_log(spark, directory), ["user_id", "k"]).drop("__table")
    bronze = bronze.withColumn("__op", F.when(F.col("offset") % 5 == 0, F.col("__op")))
    roots = root_snapshot(spark, directory)
    dirty = roots.where("c_custkey % 3 = 0").withColumn("inner", F.struct(F.lit("x").alias("__deleted")))
    gold = publish(roots.where("c_custkey % 3 <> 0"), "c_custkey").unionByName(publish(dirty, "c_custkey"))
    return checks.layer_hygiene(bronze, gold)


_ARRAYS = {"orders": "o_orderkey", "prefs": "k"}


@query(
    f"""WITH {LIVE_SQL}
    SELECT child, n_facts, CAST(0 AS BIGINT) AS n_differences FROM (
      SELECT '' AS child, 4 * count(*) AS n_facts FROM customer
      UNION ALL SELECT 'orders', 3 * count(*) FROM orders JOIN customer ON c_custkey = o_custkey
      UNION ALL SELECT 'prefs', 2 * count(*) FROM live JOIN customer ON c_custkey = user_id
    )"""
)
def path_parity(spark, directory):
    """Facts of the fold from tables against those regrouped from flat rows."""
    tables = shop_tables(spark, directory)
    folded = checks.facts(build_profiles(SHOP, tables, plan="union"), "c_custkey", _ARRAYS)
    regrouped = checks.facts(assemble(SHOP, flat_rows(SHOP, tables)), "c_custkey", _ARRAYS)
    return checks.parity_summary(folded, regrouped)


_PREF_SHOP = SHOP.with_(children=(PREFS,), fields=("c_custkey", "c_name"))


def _streamed_documents(spark, directory):
    """The change log as record files through the stateful stream: no code of the batch fold."""
    folder = workspace(spark, "records")
    log = pref_log(spark, directory)
    row = F.to_json(F.struct("user_id", "k", "event_type", "value", "__op", "__deleted"))
    records = log.select("topic", "partition", "offset", F.lit("").alias("key"), row.alias("value"),
                         F.timestamp_millis("__source_ts_ms").alias("timestamp"))
    customer_records(spark, directory).unionByName(records).write.parquet(folder)
    topics = {"customer": CUSTOMER_TOPIC, "pref": TOPIC}
    stream = stream_files(spark, folder)
    logs = {t: decode(stream.where(F.col("topic") == topics[t]), SCHEMAS[t])[0] for t in SCHEMAS}
    partitions = str(spark.sparkContext.defaultParallelism)
    with settings(spark, {**ROCKSDB, "spark.sql.shuffle.partitions": partitions}):
        docs = fold_stream(_PREF_SHOP, logs, SCHEMAS)
        gold = KeyedTable(spark, workspace(spark, "gold"), docs.schema, ["c_custkey"], by="c_custkey", buckets=8)
        writer = docs.writeStream.outputMode("update").foreachBatch(gold.append)
        writer = writer.option("checkpointLocation", workspace(spark, "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return gold.current().drop("batch_id")


def _three_sides(spark, directory):
    tables = {"customer": load(spark, directory, "customer"), "pref": live_prefs(spark, directory)}
    fields, arrays = {"": ["c_name"]}, {"prefs": "k"}
    return {
        "stream": checks.facts(_streamed_documents(spark, directory), "c_custkey", arrays, fields),
        "batch": checks.facts(build_profiles(_PREF_SHOP, tables), "c_custkey", arrays, fields),
        "baseline": relational_facts(_PREF_SHOP, tables, ["c_name"]),
    }


_N_FACTS_SQL = f"""WITH {LIVE_SQL},
    n AS (
      SELECT (SELECT count(*) FROM customer)
             + 2 * (SELECT count(*) FROM live JOIN customer ON c_custkey = user_id) AS n
    )"""


@query(
    _N_FACTS_SQL
    + """
    SELECT unnest(['stream', 'batch', 'baseline']) AS side, n AS n_facts, CAST(0 AS BIGINT) AS n_buckets_differing
    FROM n
    """
)
def path_parity_three_ways(spark, directory):
    """The stateful stream, the batch fold and the rows themselves, by digests; they share no fold."""
    summary = Parity(_three_sides(spark, directory)).summary()
    return summary.select("side", F.col("n_facts").cast("bigint"), "n_buckets_differing")


@query(
    f"""WITH {LIVE_SQL}
    SELECT CAST(user_id AS VARCHAR) AS key, 'prefs' AS child, CAST(k AS VARCHAR) AS child_key, 'event_type' AS field,
           event_type AS batch, CASE WHEN user_id % 50 = 0 THEN NULL ELSE 'other' END AS damaged,
           event_type AS baseline, CASE WHEN user_id % 50 = 0 THEN 0 ELSE 1 END::BIGINT AS n_damaged
    FROM live JOIN customer ON c_custkey = user_id WHERE k % 10 = 3 AND (user_id % 50 = 0 OR user_id % 70 = 1)
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), '', '', 'c_name', c_name, NULL, c_name, 1 FROM customer WHERE c_custkey % 90 = 2
    """
)
def path_parity_damaged(spark, directory):
    """Documents that lost elements, hold a wrong value or a null name: the facts that differ are named."""
    tables = {"customer": load(spark, directory, "customer"), "pref": live_prefs(spark, directory)}
    docs = build_profiles(_PREF_SHOP, tables)
    fields, arrays = {"": ["c_name"], "prefs": ["event_type"]}, {"prefs": "k"}
    lost = F.filter("prefs", lambda e: (F.col("c_custkey") % 50 != 0) | (e["k"] % 10 != 3))
    wrong = F.transform(lost, lambda e: F.when(
        (F.col("c_custkey") % 70 == 1) & (e["k"] % 10 == 3), e.withField("event_type", F.lit("other"))
    ).otherwise(e))
    name = F.when(F.col("c_custkey") % 90 != 2, F.col("c_name"))
    sides = {
        "batch": checks.facts(docs, "c_custkey", arrays, fields),
        "damaged": checks.facts(docs.withColumns({"prefs": wrong, "c_name": name}), "c_custkey", arrays, fields),
        "baseline": relational_facts(_PREF_SHOP, tables, ["c_name"]).where("field <> 'value'"),
    }
    return Parity(sides).differences().drop("n_batch", "n_baseline")


@query(
    f"""WITH {LIVE_SQL}
    SELECT (SELECT count(*) FROM live WHERE user_id IN (SELECT c_custkey FROM customer)) AS n_items,
           CAST(0 AS BIGINT) AS n_differences
    """
)
def replay_idempotent(spark, directory):
    """The log folded once against the log folded after being delivered twice."""
    log = pref_log(spark, directory)
    roots = root_snapshot(spark, directory).withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0))
    spec = SHOP.with_(children=(PREFS,))
    once = profiles_from_logs(spec, {"customer": roots, "pref": log})
    twice = profiles_from_logs(spec, {"customer": roots.unionByName(roots), "pref": log.unionByName(log)})
    differing = checks.multiset_difference(once, twice)
    counts = once.select(F.size("prefs").cast("bigint").alias("n_items"), F.lit(0).alias("n_differences"))
    counts = counts.unionByName(
        differing.select(F.lit(0).cast("bigint").alias("n_items"), F.lit(1).alias("n_differences"))
    )
    return counts.agg(F.sum("n_items").alias("n_items"), F.sum("n_differences").alias("n_differences"))
