"""The given tables in the roles of root, children, change log and edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcgold.functions.values import millis
from cdcgold.operators.latest import live, latest
from cdcgold.sources.tables import read_parquet
from cdcgold.spec import ChildSpec, ProfileSpec

ORDERS = ChildSpec(
    "orders", "o_orderkey", "o_custkey", "orders",
    ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
)
PREFS = ChildSpec("pref", "k", "user_id", "prefs", ("k", "event_type", "value"))
LINKS = ChildSpec(
    "link", "event_id", "from_user", "links", ("event_id", "from_user", "to_user"), other_fk="to_user"
)

SHOP = ProfileSpec(
    root="customer", key="c_custkey", children=(ORDERS, PREFS), status_field="c_mktsegment"
)
LINKED = SHOP.with_(children=(LINKS,), direction="both", slices=2)
ORDER_LINES = ProfileSpec(
    root="orders",
    key="o_orderkey",
    children=(
        ChildSpec(
            "lineitem", ("l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "lines",
            ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"),
        ),
    ),
)
TALKS = ProfileSpec(
    root="talk",
    key="conv_id",
    children=(ChildSpec("conversations", "turn", "conv_id", "turns", ("turn", "role", "text")),),
)

# Which change each kind of event stands for.
EVENT_OPS = {"signup": "c", "click": "u", "view": "u", "purchase": "u", "error": "d"}

DELETED_EVENT = "error"
TOPIC = "src.shop.pref"


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_parquet(spark, directory, table)


def op_of(event_type: str = "event_type") -> Column:
    expr = F.lit(None).cast("string")
    for kind, op in EVENT_OPS.items():
        expr = F.when(F.col(event_type) == kind, op).otherwise(expr)
    return expr


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def pref_log(spark: SparkSession, directory: str) -> DataFrame:
    """The event table as a decoded change log of preference rows."""
    events = load(spark, directory, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.lit(TOPIC).alias("topic"),
        F.pmod(k, F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        "user_id",
        k.alias("k"),
        "event_type",
        "value",
        op_of().alias("__op"),
        F.lit("pref").alias("__table"),
        millis("ts").alias("__source_ts_ms"),
        (F.col("event_type") == DELETED_EVENT).cast("string").alias("__deleted"),
    )


def live_prefs(spark: SparkSession, directory: str) -> DataFrame:
    return live(latest(pref_log(spark, directory), ["user_id", "k"]))


def links(spark: SparkSession, directory: str) -> DataFrame:
    """Each event as an edge between two customers: its user and the one it names."""
    events = load(spark, directory, "events")
    return events.select(
        "event_id",
        F.col("user_id").alias("from_user"),
        F.get_json_object("props", "$.k").cast("bigint").alias("to_user"),
    )


def root_log(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as a change of its user's root row."""
    log = pref_log(spark, directory)
    return log.select(
        "topic",
        F.lit(0).alias("partition"),
        "offset",
        F.col("user_id").alias("c_custkey"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("c_name"),
        F.col("event_type").alias("c_mktsegment"),
        "__op",
        F.lit("customer").alias("__table"),
        "__source_ts_ms",
        "__deleted",
    )


def root_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "customer").select("c_custkey", "c_name", "c_mktsegment")


def shop_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {
        "customer": load(spark, directory, "customer"),
        "orders": load(spark, directory, "orders"),
        "pref": live_prefs(spark, directory),
        "link": links(spark, directory),
    }


def text_of(array: str, *fields: str) -> Column:
    """An array of structs as text, elements in array order."""
    element = F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))
    return F.array_join(element, ",")


def documents_flat(docs: DataFrame) -> DataFrame:
    """Shop documents as scalar columns."""
    total = F.aggregate("orders", F.lit(0).cast("bigint"), lambda a, o: a + cents(o["o_totalprice"]))
    return docs.select(
        "c_custkey",
        "segment",
        "segments",
        "c_name",
        "c_mktsegment",
        F.size("orders").cast("bigint").alias("n_orders"),
        total.alias("orders_cents"),
        text_of("orders", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("orders_text"),
        F.size("prefs").cast("bigint").alias("n_prefs"),
        text_of("prefs", "k", "event_type").alias("prefs_text"),
    )


# ---- the same roles in SQL ------------------------------------------------------------

LOG_SQL = """
log AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""

LIVE_SQL = (
    LOG_SQL
    + """,
state AS (
  SELECT user_id, k, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
  FROM log GROUP BY user_id, k
),
live AS (SELECT * FROM state WHERE event_type <> 'error')"""
)


def slot_sql(text: str, slots: str) -> str:
    """The slot function of the library in SQL."""
    return f"CAST('0x' || left(md5({text}), 8) AS BIGINT) % {slots}"


def roots_sql(slices: int = 1) -> str:
    """Every document's rows, as many as the spec has slices."""
    return f"""
roots AS (
  SELECT c_custkey, c_name, c_mktsegment, {slices} AS segments, s AS segment
  FROM customer, range({slices}) slices(s)
)"""


def documents_sql(slices: int = 1) -> str:
    """The flat documents of ``documents_flat``."""
    return f"""
WITH {LIVE_SQL},
{roots_sql(slices)},
o AS (
  SELECT c_custkey, segment, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
         string_agg(o_orderkey || ':' || o_orderstatus || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS t
  FROM roots JOIN orders ON o_custkey = c_custkey
   AND segment = {slot_sql('CAST(o_orderkey AS VARCHAR)', 'segments')}
  GROUP BY 1, 2
),
p AS (
  SELECT c_custkey, segment, count(*) AS n, string_agg(k || ':' || event_type, ',' ORDER BY k) AS t
  FROM roots JOIN live ON user_id = c_custkey
   AND segment = {slot_sql('CAST(k AS VARCHAR)', 'segments')}
  GROUP BY 1, 2
)
SELECT c_custkey, CAST(segment AS INTEGER) AS segment, CAST(segments AS INTEGER) AS segments, c_name, c_mktsegment,
       coalesce(o.n, 0) AS n_orders, CAST(coalesce(o.cents, 0) AS BIGINT) AS orders_cents,
       coalesce(o.t, '') AS orders_text, coalesce(p.n, 0) AS n_prefs, coalesce(p.t, '') AS prefs_text
FROM roots LEFT JOIN o USING (c_custkey, segment) LEFT JOIN p USING (c_custkey, segment)
"""


DOCUMENTS_SQL = documents_sql()
