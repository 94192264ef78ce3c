"""Latest state, nested documents and the relational reads that must agree with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcgold.operators.edges import either_end, left_join_many, one_end
from cdcgold.operators.flat import assemble, baseline_profiles, flat_rows, rows_scanned
from cdcgold.operators.fold import build_profiles, only_parents, profiles_from_logs
from cdcgold.operators.latest import latest, live, snapshot_then_log
from cdcgold.operators.snapshot import PHASE, merge_chunks, read_chunks
from cdcgold.plans.registry import query
from cdcgold.plans.shop import (
    DOCUMENTS_SQL,
    LINKED,
    LIVE_SQL,
    LOG_SQL,
    ORDER_LINES,
    ORDERS,
    PREFS,
    SHOP,
    TALKS,
    cents,
    documents_flat,
    documents_sql,
    links,
    live_prefs,
    load,
    pref_log,
    root_log,
    root_snapshot,
    shop_tables,
    slot_sql,
    text_of,
)
from cdcgold.spec import ChildSpec


@query(
    f"""WITH {LIVE_SQL}
    SELECT user_id, k, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM live"""
)
def fold_live_children(spark, directory):
    live = live_prefs(spark, directory)
    return live.select("user_id", "k", "event_type", cents(F.col("value")).alias("cents"))


@query(DOCUMENTS_SQL)
def profile_documents(spark, directory):
    return documents_flat(build_profiles(SHOP, shop_tables(spark, directory)))


@query(DOCUMENTS_SQL)
def profile_one_shuffle(spark, directory):
    return documents_flat(build_profiles(SHOP, shop_tables(spark, directory), plan="union"))


@query(documents_sql(3))
def profile_documents_sliced(spark, directory):
    return documents_flat(build_profiles(SHOP.with_(slices=3), shop_tables(spark, directory)))


@query(DOCUMENTS_SQL)
def assemble_from_flat(spark, directory):
    return documents_flat(assemble(SHOP, flat_rows(SHOP, shop_tables(spark, directory))))


def _root_delete(policy):
    def build(spark, directory):
        log = snapshot_then_log(root_snapshot(spark, directory), root_log(spark, directory))
        orders = load(spark, directory, "orders").withColumn("partition", F.lit(0)).withColumn("offset", F.col("o_orderkey"))
        spec = SHOP.with_(root_delete=policy, children=(ORDERS,))
        docs = profiles_from_logs(spec, {"customer": log, "orders": orders})
        return docs.groupBy("c_custkey", "c_name", "c_mktsegment").agg(
            F.sum(F.size("orders")).cast("bigint").alias("n_orders")
        )

    return build


_ROOTS_SQL = """
WITH changes AS (
  SELECT c_custkey, c_name, c_mktsegment, -1 AS pos, FALSE AS gone FROM customer
  UNION ALL
  SELECT user_id, 'user-' || user_id, event_type, event_id, event_type = 'error' FROM events
),
last AS (
  SELECT c_custkey, arg_max(c_name, pos) AS c_name, arg_max(c_mktsegment, pos) AS c_mktsegment,
         arg_max(gone, pos) AS gone
  FROM changes GROUP BY c_custkey
),
n AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT c_custkey, c_name, {status} AS c_mktsegment, coalesce(n_orders, 0) AS n_orders
FROM last LEFT JOIN n ON o_custkey = c_custkey WHERE {keep}
"""


@query(_ROOTS_SQL.format(status="c_mktsegment", keep="TRUE"))
def root_delete_keep(spark, directory):
    return _root_delete("keep")(spark, directory)


@query(_ROOTS_SQL.format(status="CASE WHEN gone THEN 'DELETED' ELSE c_mktsegment END", keep="TRUE"))
def root_delete_mark(spark, directory):
    return _root_delete("mark")(spark, directory)


@query(_ROOTS_SQL.format(status="c_mktsegment", keep="NOT gone"))
def root_delete_drop(spark, directory):
    return _root_delete("drop")(spark, directory)


def _reparent(policy, spark, directory):
    customers = root_snapshot(spark, directory).withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0))
    spec = SHOP.with_(reparent=policy, children=(PREFS,))
    docs = profiles_from_logs(spec, {"customer": customers, "pref": pref_log(spark, directory)})
    return docs.select(
        "c_custkey", "segment", F.size("prefs").cast("bigint").alias("n_prefs"),
        text_of("prefs", "k", "event_type").alias("prefs_text"),
    )


_REPARENT_SQL = """
, folded AS (
  SELECT user_id, count(*) AS n, string_agg(k || ':' || event_type, ',' ORDER BY k) AS t
  FROM {live} GROUP BY user_id
)
SELECT c_custkey, CAST(0 AS INTEGER) AS segment, coalesce(n, 0) AS n_prefs, coalesce(t, '') AS prefs_text
FROM customer LEFT JOIN folded ON user_id = c_custkey
"""


@query(f"WITH {LIVE_SQL}{_REPARENT_SQL.format(live='live')}")
def reparent_keep(spark, directory):
    return _reparent("keep_both", spark, directory)


@query(
    f"""WITH {LOG_SQL}, moved AS (
      SELECT k, arg_max(user_id, event_id) AS user_id, arg_max(event_type, event_id) AS event_type
      FROM log GROUP BY k HAVING arg_max(event_type, event_id) <> 'error'
    ){_REPARENT_SQL.format(live='moved')}"""
)
def reparent_move(spark, directory):
    return _reparent("move", spark, directory)


@query(
    """
    WITH rows AS (
      SELECT c_custkey AS key, -1 AS pos, c_mktsegment AS status, 'r' AS op FROM customer
      UNION ALL
      SELECT user_id, event_id, event_type,
             CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END FROM events
    )
    SELECT key AS c_custkey, arg_max(status, pos) AS c_mktsegment, arg_max(op, pos) AS op,
           CAST(max(pos) AS BIGINT) AS pos
    FROM rows GROUP BY key
    """
)
def snapshot_plus_log(spark, directory):
    log = snapshot_then_log(root_snapshot(spark, directory), root_log(spark, directory))
    return latest(log, ["c_custkey"]).select(
        "c_custkey", "c_mktsegment", F.col("__op").alias("op"), F.col("offset").alias("pos")
    )


@query(
    """
    SELECT c_custkey, c_name, o_orderkey, o_orderstatus
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    """
)
def flat_join(spark, directory):
    customers = load(spark, directory, "customer").select("c_custkey", "c_name")
    orders = load(spark, directory, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"
    )
    return left_join_many(customers, orders, "c_custkey")


@query(
    f"""WITH {LIVE_SQL}
    SELECT c_custkey, c_name, 'orders' AS child, o_orderkey AS child_key
    FROM customer JOIN orders ON o_custkey = c_custkey
    UNION ALL
    SELECT c_custkey, c_name, 'prefs', k FROM customer JOIN live ON user_id = c_custkey
    UNION ALL
    SELECT c_custkey, c_name, '', -1 FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM live)
    """
)
def flat_stacked(spark, directory):
    flat = flat_rows(SHOP, shop_tables(spark, directory))
    key = F.coalesce(F.col("orders.key.o_orderkey"), F.col("prefs.key.k"), F.lit(-1))
    return flat.select(
        "c_custkey", "c_name", F.coalesce("child", F.lit("")).alias("child"), key.alias("child_key")
    )


@query(
    """
    SELECT c_custkey, count(*) AS rows_scanned
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey
    GROUP BY c_custkey
    """
)
def rows_scanned_per_root(spark, directory):
    spec = SHOP.with_(children=(ORDERS, ChildSpec("event", "event_id", "user_id", "events", ("event_id",))))
    tables = {**shop_tables(spark, directory), "event": load(spark, directory, "events")}
    counted = rows_scanned(spec, tables)
    return counted.select("c_custkey", F.col("rows_scanned").try_cast("bigint").alias("rows_scanned"))


@query(
    f"""WITH {LOG_SQL}
    SELECT c_custkey, event_id, user_id AS from_user, k AS to_user
    FROM customer LEFT JOIN log ON user_id = c_custkey OR k = c_custkey
    """
)
def edge_join_both(spark, directory):
    customers = load(spark, directory, "customer").select("c_custkey")
    ends = either_end(links(spark, directory), "from_user", "to_user", "c_custkey")
    return left_join_many(customers, ends, "c_custkey")


@query(
    f"""WITH {LOG_SQL}
    SELECT c_custkey, event_id, user_id AS from_user, k AS to_user
    FROM customer LEFT JOIN log ON user_id = c_custkey
    """
)
def edge_join_from(spark, directory):
    customers = load(spark, directory, "customer").select("c_custkey")
    ends = one_end(links(spark, directory), "from_user", "c_custkey")
    return left_join_many(customers, ends, "c_custkey")


_LINKED_SQL = f"""
WITH {LOG_SQL},
ends AS (
  SELECT user_id AS key, event_id, user_id, k FROM log
  UNION ALL SELECT k, event_id, user_id, k FROM log WHERE k <> user_id
),
roots AS (SELECT c_custkey, 2 AS segments, s AS segment FROM customer, range(2) slices(s)),
folded AS (
  SELECT c_custkey, segment, count(*) AS n,
         string_agg(event_id || ':' || user_id || ':' || k, ',' ORDER BY event_id) AS t
  FROM roots JOIN ends ON key = c_custkey AND segment = {slot_sql('CAST(event_id AS VARCHAR)', 'segments')}
  GROUP BY 1, 2
)
SELECT c_custkey, CAST(segment AS INTEGER) AS segment, coalesce(n, 0) AS n_links, coalesce(t, '') AS links_text
FROM roots LEFT JOIN folded USING (c_custkey, segment)
"""


@query(_LINKED_SQL)
def edge_documents_both(spark, directory):
    docs = build_profiles(LINKED, shop_tables(spark, directory))
    return docs.select(
        "c_custkey", "segment", F.size("links").cast("bigint").alias("n_links"),
        text_of("links", "event_id", "from_user", "to_user").alias("links_text"),
    )


@query(
    f"""WITH {LIVE_SQL},
    o AS (
      SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2
    ),
    po AS (
      SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority || ':' || first_key, ',' ORDER BY first_key) AS t
      FROM o GROUP BY 1
    ),
    e AS (
      SELECT user_id, event_type, min(k) AS first_key FROM live GROUP BY 1, 2
    ),
    pe AS (
      SELECT user_id, count(*) AS n, string_agg(event_type || ':' || first_key, ',' ORDER BY first_key) AS t
      FROM e GROUP BY 1
    ),
    flat AS (
      SELECT c_custkey, count(*) AS rows_scanned
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN live ON user_id = c_custkey GROUP BY 1
    )
    SELECT c_custkey, c_name, coalesce(po.n, 0) AS n_orders, coalesce(po.t, '') AS orders_text,
           coalesce(pe.n, 0) AS n_prefs, coalesce(pe.t, '') AS prefs_text, rows_scanned
    FROM customer JOIN flat USING (c_custkey)
    LEFT JOIN po ON o_custkey = c_custkey LEFT JOIN pe ON user_id = c_custkey
    """
)
def baseline_profile(spark, directory):
    orders = ChildSpec(
        "orders", "o_orderkey", "o_custkey", "orders", ("o_orderpriority", "o_orderkey"), dedupe="o_orderpriority"
    )
    prefs = ChildSpec("pref", "k", "user_id", "prefs", ("event_type", "k"), dedupe="event_type")
    spec = SHOP.with_(children=(orders, prefs), fields=("c_custkey", "c_name"))
    docs = baseline_profiles(spec, shop_tables(spark, directory))
    return docs.select(
        "c_custkey",
        "c_name",
        F.size("orders").cast("bigint").alias("n_orders"),
        text_of("orders", "o_orderpriority", "o_orderkey").alias("orders_text"),
        F.size("prefs").cast("bigint").alias("n_prefs"),
        text_of("prefs", "event_type", "k").alias("prefs_text"),
        F.col("rows_scanned").try_cast("bigint").alias("rows_scanned"),
    )


@query(
    f"""WITH {LOG_SQL},
    ids AS (SELECT DISTINCT user_id * 3 AS id FROM log),
    o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1),
    ends AS (
      SELECT user_id AS key, event_id FROM log UNION ALL SELECT k, event_id FROM log WHERE k <> user_id
    ),
    l AS (SELECT key, count(*) AS n FROM ends GROUP BY 1)
    SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders, coalesce(o.t, '') AS orders_text, coalesce(l.n, 0) AS n_links
    FROM customer JOIN ids ON id = c_custkey LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN l ON key = c_custkey
    """
)
def profiles_of_ids(spark, directory):
    """Documents of a list of keys: every table is cut to the list before it is folded."""
    tables = shop_tables(spark, directory)
    ids = tables["link"].select(F.col("from_user") * 3).distinct()
    spec = LINKED.with_(children=(ORDERS, *LINKED.children), slices=1)
    docs = build_profiles(spec, only_parents(spec, tables, ids))
    return docs.select(
        "c_custkey", "c_name", F.size("orders").cast("bigint").alias("n_orders"),
        text_of("orders", "o_orderkey").alias("orders_text"), F.size("links").cast("bigint").alias("n_links"),
    )


@query(
    """
    WITH l AS (
      SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
             string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_returnflag, ','
                        ORDER BY l_linenumber, l_partkey, l_suppkey) AS t
      FROM lineitem GROUP BY 1
    )
    SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS n_lines, coalesce(qty, 0) AS quantity,
           coalesce(t, '') AS lines_text
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
    """
)
def order_documents(spark, directory):
    tables = {t: load(spark, directory, t) for t in ("orders", "lineitem")}
    docs = build_profiles(ORDER_LINES, tables)
    quantity = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["l_quantity"].cast("bigint"))
    return docs.select(
        "o_orderkey",
        "o_orderstatus",
        F.size("lines").cast("bigint").alias("n_lines"),
        quantity.alias("quantity"),
        text_of("lines", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("lines_text"),
    )


@query(
    """
    SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars,
           md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest
    FROM conversations GROUP BY conv_id
    """
)
def conversation_documents(spark, directory):
    turns = load(spark, directory, "conversations")
    docs = build_profiles(TALKS, {"talk": turns.select("conv_id").distinct(), "conversations": turns})
    joined = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "|")
    chars = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"]))
    return docs.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), chars.alias("n_chars"), F.md5(joined).alias("digest")
    )


@query(DOCUMENTS_SQL)
def chunked_snapshot(spark, directory):
    """The documents from a log whose older two thirds are gone, and four chunks read while it went on.

    The chunks, ranges of the user's key in no order, each show the table at a moment of their own
    within their marks; what the log changes between those marks comes from the log.
    """
    log = pref_log(spark, directory).drop("topic", "partition")
    end = log.agg(F.max("offset")).first()[0] + 1
    retained = log.where(F.col("offset") > 2 * end // 3)
    moment = iter(range(12))  # where the log is, in twelfths of its last third

    def position(step=end // 36):
        return 2 * end // 3 + next(moment) * step

    def read(part):
        now = position()
        state = live(latest(log.where((F.col("offset") <= now) & (F.pmod("user_id", F.lit(4)) == part)), _PREF, ["offset"]))
        return state.select("user_id", "k", "event_type", "value")

    chunks = read_chunks([2, 0, 3, 1], read, position)
    merged = merge_chunks(retained, chunks, _PREF, "offset")
    prefs = live(latest(merged, _PREF, ["offset", PHASE])).drop("offset", PHASE)
    return documents_flat(build_profiles(SHOP, shop_tables(spark, directory) | {"pref": prefs}))


_PREF = ["user_id", "k"]
