"""Consumer views of documents and operators on their arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.functions import arrays as A
from cdcgold.functions.values import slot
from cdcgold.operators import views
from cdcgold.operators.decode import publish
from cdcgold.operators.fold import build_profiles
from cdcgold.plans.registry import query
from cdcgold.plans.shop import (
    LINKED,
    LIVE_SQL,
    LOG_SQL,
    SHOP,
    load,
    roots_sql,
    shop_tables,
    slot_sql,
    text_of,
)
from cdcgold.session import materialise


def _docs(spark, directory):
    return build_profiles(SHOP, shop_tables(spark, directory))


_ROOTS = f"WITH {LIVE_SQL},\n{roots_sql()}"
_IN_SEGMENT = f"segment = {slot_sql('CAST(k AS VARCHAR)', 'segments')}"


@query(
    f"""{_ROOTS},
    asked AS (SELECT DISTINCT user_id * 13 AS c_custkey FROM events)
    SELECT asked.c_custkey, coalesce(CAST(segment AS INTEGER), -1) AS segment, c_name IS NOT NULL AS found,
           coalesce(c_name, '') AS c_name
    FROM asked LEFT JOIN roots USING (c_custkey)
    """
)
def bulk_lookup(spark, directory):
    asked = load(spark, directory, "events").select((F.col("user_id") * 13).alias("c_custkey"))
    found = views.lookup(_docs(spark, directory), asked, "c_custkey")
    return found.select(
        "c_custkey",
        F.coalesce("segment", F.lit(-1)).alias("segment"),
        "found",
        F.coalesce("c_name", F.lit("")).alias("c_name"),
    )


@query(
    f"""{_ROOTS}
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment, c_name FROM roots
    WHERE c_custkey IN (SELECT user_id FROM events)
    """
)
def gold_scan_ids(spark, directory):
    ids = load(spark, directory, "events").select(F.col("user_id").alias("c_custkey"))
    return views.scan_ids(_docs(spark, directory), ids, "c_custkey", ["c_custkey", "segment", "c_name"])


@query(
    f"""{_ROOTS}
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment, c_name FROM roots WHERE c_mktsegment = 'BUILDING'
    """
)
def find_by_status(spark, directory):
    docs = views.find_by(_docs(spark, directory), "c_mktsegment", "BUILDING")
    return docs.select("c_custkey", "segment", "c_name")


@query(
    f"""WITH {LOG_SQL}
    SELECT DISTINCT k AS to_user, user_id AS c_custkey FROM log
    WHERE user_id IN (SELECT c_custkey FROM customer)
    """
)
def reverse_edge_lookup(spark, directory):
    docs = build_profiles(LINKED.with_(direction="from"), shop_tables(spark, directory))
    return views.reverse_index(docs, "c_custkey", "links", "to_user")


@query(
    f"""WITH {LOG_SQL}
    SELECT c_custkey, count(*) AS n FROM customer JOIN log ON user_id = c_custkey
    GROUP BY 1 HAVING bool_or(k = 7)
    """
)
def reverse_edge_of_one(spark, directory):
    spec = LINKED.with_(direction="from", slices=1)
    docs = build_profiles(spec, shop_tables(spark, directory))
    hit = views.reverse_edges(docs, "links", "to_user", 7)
    return hit.select("c_custkey", F.size("links").cast("bigint").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_profiles(spark, directory):
    orders = load(spark, directory, "orders")
    return views.newest(orders, "o_orderdate", 50, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 200")
def sample_first_n(spark, directory):
    customers = load(spark, directory, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return views.first_n(customers, "c_custkey", 200)


@query(
    f"""WITH {LIVE_SQL},
    o AS (
      SELECT o_custkey, min(o_orderkey) AS first_key, arg_min(o_orderstatus, o_orderkey) AS first_status,
             count(*) AS n
      FROM orders GROUP BY 1
    ),
    p AS (
      SELECT user_id, min(k) AS first_k, arg_min(event_type, k) AS first_type, count(*) AS n FROM live GROUP BY 1
    )
    SELECT c_custkey, c_name || ' ' || c_mktsegment AS display_name,
           coalesce(first_key, -1) AS order_key, coalesce(first_status, '') AS order_status,
           coalesce(first_k, -1) AS pref_k, coalesce(first_type, '') AS pref_type,
           coalesce(p.n, 0) AS pref_count
    FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN p ON user_id = c_custkey
    """
)
def summary_view(spark, directory):
    gold = materialise(_docs(spark, directory), "gold")
    slim = views.summary(
        gold,
        "c_custkey",
        name=("c_name", "c_mktsegment"),
        first={
            "order": ("orders", "o_orderkey", {"key": "o_orderkey", "status": "o_orderstatus"}),
            "pref": ("prefs", "k", {"k": "k", "type": "event_type"}),
        },
        counts={"pref_count": "prefs"},
    )
    return slim.select(
        "c_custkey",
        "display_name",
        F.coalesce("order.key", F.lit(-1)).alias("order_key"),
        F.coalesce("order.status", F.lit("")).alias("order_status"),
        F.coalesce("pref.k", F.lit(-1)).alias("pref_k"),
        F.coalesce("pref.type", F.lit("")).alias("pref_type"),
        "pref_count",
    )


@query(
    f"""{_ROOTS},
    p AS (
      SELECT c_custkey, segment, to_json(list(struct_pack(k := k, event_type := event_type) ORDER BY k)) AS prefs
      FROM roots JOIN live ON user_id = c_custkey AND {_IN_SEGMENT} GROUP BY 1, 2
    )
    SELECT CAST(c_custkey AS VARCHAR) AS key,
           '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || segment
           || ',"prefs":' || coalesce(CAST(prefs AS VARCHAR), '[]') || '}}' AS value
    FROM roots LEFT JOIN p USING (c_custkey, segment)
    """
)
def publish_documents(spark, directory):
    slim = F.transform("prefs", lambda p: F.struct(p["k"].alias("k"), p["event_type"].alias("event_type")))
    docs = _docs(spark, directory).select("c_custkey", "c_name", "segment", slim.alias("prefs"))
    return publish(docs, "c_custkey")


def _prefs_sql(text: str) -> str:
    """Per document segment, ``text`` over its preferences; x is the key the query is about."""
    return f"""{_ROOTS},
    keyed AS (
      SELECT roots.*, c_custkey % 100 AS x,
             segment = {slot_sql('CAST(c_custkey % 100 AS VARCHAR)', 'segments')} AS here
      FROM roots
    ),
    p AS (
      SELECT c_custkey, segment,
             string_agg(k || ':' || event_type, ',' ORDER BY k) AS all_text,
             string_agg(k || ':' || event_type, ',' ORDER BY k) FILTER (WHERE k <> x) AS rest_text
      FROM keyed JOIN live ON user_id = c_custkey AND {_IN_SEGMENT} GROUP BY 1, 2
    )
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment, {text} AS prefs_text
    FROM keyed LEFT JOIN p USING (c_custkey, segment)
    """


def _x():
    return F.col("c_custkey") % 100


def _here():
    """True in the segment an element of key x belongs to."""
    return F.col("segment") == slot([_x()], F.col("segments"))


def _element(kind: str):
    return F.struct(_x().alias("k"), F.lit(kind).alias("event_type"), F.lit(0.5).alias("value"))


def _with_text(docs, array):
    changed = docs.withColumn("_a", array)
    return changed.select("c_custkey", "segment", text_of("_a", "k", "event_type").alias("prefs_text"))


@query(_prefs_sql("coalesce(rest_text, '')"))
def array_remove(spark, directory):
    return _with_text(_docs(spark, directory), A.remove_by_key("prefs", "k", _x()))


@query(_prefs_sql("concat_ws(',', all_text, CASE WHEN here THEN x || ':pushed' END)"))
def array_append(spark, directory):
    pushed = A.append_element("prefs", _element("pushed"))
    return _with_text(_docs(spark, directory), F.when(_here(), pushed).otherwise(F.col("prefs")))


@query(_prefs_sql("concat_ws(',', rest_text, CASE WHEN here THEN x || ':upserted' END)"))
def array_upsert(spark, directory):
    upserted = A.upsert_element("prefs", "k", _element("upserted"))
    return _with_text(_docs(spark, directory), F.when(_here(), upserted).otherwise(F.col("prefs")))


@query(
    f"""{_ROOTS},
    entries AS (
      SELECT c_custkey, segment, k, event_type FROM roots JOIN live ON user_id = c_custkey AND {_IN_SEGMENT}
      WHERE k <> c_custkey % 100 AND k <> (c_custkey + 1) % 100
      UNION ALL
      SELECT c_custkey, segment, c_custkey % 100, 'put' FROM roots
      WHERE segment = {slot_sql('CAST(c_custkey % 100 AS VARCHAR)', 'segments')}
    )
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment,
           coalesce(string_agg(event_type, ',' ORDER BY k), '') AS values_text
    FROM roots LEFT JOIN entries USING (c_custkey, segment) GROUP BY 1, 2
    """
)
def map_put_remove(spark, directory):
    entries = F.transform("prefs", lambda p: F.struct(p["k"], p["event_type"]))
    docs = _docs(spark, directory).withColumn("_m", F.map_from_entries(entries))
    put = F.when(_here(), A.map_put("_m", _x(), F.lit("put"))).otherwise(F.col("_m"))
    docs = docs.withColumn("_m", put)
    docs = docs.withColumn("_m", A.map_remove("_m", (F.col("c_custkey") + 1) % 100))
    return docs.select("c_custkey", "segment", F.array_join(A.map_to_array("_m"), ",").alias("values_text"))


@query(
    f"""{_ROOTS},
    p AS (
      SELECT c_custkey, segment, list(k ORDER BY k) AS ks
      FROM roots JOIN live ON user_id = c_custkey AND {_IN_SEGMENT} GROUP BY 1, 2
    )
    SELECT c_custkey, CAST(segment AS INTEGER) AS segment, coalesce(ks[1], -1) AS first_k,
           coalesce(array_to_string(ks[1:2], ','), '') AS first_two, coalesce(len(ks), 0)::BIGINT AS n
    FROM roots LEFT JOIN p USING (c_custkey, segment)
    """
)
def element_reads(spark, directory):
    docs = _docs(spark, directory)
    return docs.select(
        "c_custkey",
        "segment",
        F.coalesce(A.first_element("prefs")["k"], F.lit(-1)).alias("first_k"),
        text_of(F.slice("prefs", 1, 2), "k").alias("first_two"),
        A.size_or_zero("prefs").cast("bigint").alias("n"),
    )


@query(
    """
    SELECT CAST(1 AS INTEGER) AS slices, count(*) AS n_messages, count(DISTINCT c_custkey) AS n_keys FROM customer
    UNION ALL SELECT CAST(3 AS INTEGER), 3 * count(*), 3 * count(DISTINCT c_custkey) FROM customer
    """
)
def publish_keys(spark, directory):
    """Messages and distinct keys of both layouts of the documents."""
    out = []
    for slices, key in ((1, ["c_custkey"]), (3, ["c_custkey", "segment"])):
        sent = publish(build_profiles(SHOP.with_(slices=slices), shop_tables(spark, directory)), *key)
        counts = sent.agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("key").alias("n_keys"))
        out.append(counts.select(F.lit(slices).alias("slices"), "n_messages", "n_keys"))
    return out[0].unionByName(out[1])
