import math
import random

import pytest
from party_data import ROWS, address, customer, documents, frames, link
from pyspark.sql import functions as F

from cdcgold.functions import arrays as A
from cdcgold.functions.cdc import is_deleted, table_of
from cdcgold.functions.values import percent
from cdcgold.operators import checks, metrics, views
from cdcgold.operators.fold import build_profiles
from cdcgold.operators.latest import latest
from cdcgold.sources import party, synth


def test_reconcile(spark):
    source = frames(spark)["customer"]
    rows = [customer(1), customer(2, first_name="Old"), customer(3, status=None), customer(4)]
    target = frames(spark, {**ROWS, "customer": rows})["customer"]
    got = documents(checks.reconcile(source, target, "customer_id", party.RECONCILED_FIELDS))
    assert [got[f"p{i}"]["verdict"] for i in range(1, 6)] == ["OK", "STALE", "STALE", "OK", "MISSING"]
    assert got["p2"]["diffs"] == [{"field": "first_name", "source": "First2", "target": "Old"}]
    assert got["p3"]["diffs"][0]["target"] is None and got["p5"]["diffs"] == []
    out = checks.reconcile_summary(checks.reconcile(source, target, "customer_id", party.RECONCILED_FIELDS, limit=4))
    row = out.first()
    assert (row.total, row.ok, row.stale, row.missing, row.passed) == (4, 2, 2, 0, False)
    assert (float(row.ok_pct), float(row.missing_pct)) == (50.0, 0.0)


def test_percent_of_nothing_and_rounding(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (1, 400)], "n int, t int")
    assert [float(r[0]) for r in df.select(percent(F.col("n"), F.col("t"))).collect()] == [0.0, 33.3, 0.3]


def test_verify_changes(spark):
    docs = build_profiles(party.BULK, frames(spark))
    log = spark.createDataFrame(
        [
            ("UPDATE", "p1", "first_name", "stale", 0),
            ("UPDATE", "p1", "first_name", "First1", 1),
            ("UPDATE", "p2", "status", "INACTIVE", 2),
            ("INSERT", "p77", "first_name", "New", 3),
            ("UPDATE", "p1", "unknown", "x", 4),
        ],
        "op string, customer_id string, field string, expected string, seq int",
    )
    out = checks.verify_changes(log, docs, "customer_id", party.RECONCILED_FIELDS)
    got = {(r.customer_id, r.field): (r.actual, r.verdict) for r in out.collect()}
    assert got == {
        ("p1", "first_name"): ("First1", "PASS"),
        ("p2", "status"): ("ACTIVE", "FAIL"),
        ("p77", "first_name"): ("NOT_FOUND", "FAIL"),
        ("p1", "unknown"): ("NOT_FOUND", "FAIL"),
    }


def test_constraints_of_the_party_model(spark):
    assert checks.violations(frames(spark), party.constraints()).count() == 0
    rows = {
        **ROWS,
        "customer": [*ROWS["customer"], customer(1, status="GONE"), customer(6, first_name=None)],
        "customer_address": [*ROWS["customer_address"], address(9, "nobody"), address(10, None)],
        "relationship": [link(1, "p1", "lost")],
    }
    found = {(r.table, r.rule, r.column, r.value, r.n_rows) for r in checks.violations(frames(spark, rows), party.constraints()).collect()}
    assert found == {
        ("customer", "unique", "customer_id", "p1", 2),
        ("customer", "unique", "external_ref", "x1", 2),
        ("customer", "one_of", "status", "GONE", 1),
        ("customer", "not_null", "first_name", "null", 1),
        ("customer_address", "foreign_key", "customer_id", "nobody", 1),
        ("customer_address", "not_null", "customer_id", "null", 1),
        ("relationship", "foreign_key", "party_id_to", "lost", 1),
    }


def rank(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values) / 100) - 1)]


def test_clustered_values_spread_over_ranges(spark):
    values = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") + 1_700_000_000_000).alias("_v"), F.lit(1).alias("_n"))
    sizes = metrics._ranges(values, ["g"]).groupBy("_range").count()
    assert sizes.count() > metrics.RANGES // 2
    assert sizes.agg(F.max("count")).first()[0] < 20_000 // 50


@pytest.mark.parametrize("kind", ["ms", "narrow", "wide"])
def test_nearest_rank_percentiles(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "ms": lambda: float(rnd.randint(0, 40)),
        "narrow": lambda: 100 + rnd.random(),
        "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-6, 9),
    }[kind]
    groups = {"a": 1, "b": 2, "c": 301, "d": 100}
    data = [(g, draw()) for g, n in groups.items() for _ in range(n)]
    got = metrics.nearest_rank(spark.createDataFrame(data, "g string, v double"), ["g"], "v")
    for r in got.collect():
        values = [v for g, v in data if g == r.g]
        assert (r.p50, r.p95, r.p99) == tuple(rank(values, p) for p in (50, 95, 99))
    assert got.count() == len(groups)


def test_latency_report(spark):
    df = spark.createDataFrame([("m", i, i % 10 == 0) for i in range(1, 101)], "mode string, ms int, bad boolean")
    row = metrics.latency_report(df, ["mode"], "ms", F.col("bad"), 3).first()
    assert (row.total, row.errors, row.max, row.p50, row.p95, row.p99) == (100, 10, 100, 50, 95, 99)
    assert float(row.throughput) == 33.3


def test_catch_up(spark):
    log = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in range(5)], "topic string, partition int, offset bigint")
    ledger = spark.createDataFrame(
        [("t", 0, 0, 2, 1000), ("t", 0, 1, 4, 1500), ("t", 0, 2, 4, 1900), ("t", 1, 0, 3, 1000)],
        "topic string, partition int, batch_id bigint, end_offset bigint, gold_ms bigint",
    )
    got = {r.partition: (r.backlog, r.caught_up, r.catch_up_ms) for r in metrics.catch_up(log, ledger, 900).collect()}
    assert got == {0: (0, True, 600), 1: (1, False, None)}


def test_latest_ignores_missing_keys_and_keeps_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 1), (1, None, 0, 2), (None, "x", 0, 3)], "id int, v string, partition int, offset int"
    )
    assert [tuple(r) for r in latest(df, ["id"]).collect()] == [(1, None, 0, 2)]


def test_delete_flag_variants(spark):
    df = spark.createDataFrame([("TRUE", "u"), ("true", "u"), ("false", "d"), (None, None)], "__deleted string, __op string")
    assert [r[0] for r in df.select(is_deleted(df.columns)).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(is_deleted(df.columns, exact=True)).collect()] == [False, True, True, False]
    assert [r[0] for r in spark.range(1).select(is_deleted([])).collect()] == [False]
    assert spark.range(1).select(table_of(F.lit("a.b.customer_tax"))).first()[0] == "customer_tax"


def test_array_and_map_elements(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b")], {"x": 1, "y": 2}), (None, None)], "a array<struct<k: int, v: string>>, m map<string, int>")
    element = F.struct(F.lit(1).alias("k"), F.lit("z").alias("v"))
    out = df.select(
        A.upsert_element("a", "k", element).alias("u"),
        A.remove_by_key("a", "k", F.lit(2)).alias("r"),
        A.map_to_array(A.map_put("m", F.lit("x"), F.lit(9))).alias("p"),
        A.map_remove("m", F.lit("x")).alias("q"),
        A.size_or_zero("a").alias("n"),
        A.first_element("a").alias("f"),
    ).collect()
    first, second = out
    assert [tuple(x) for x in first.u] == [(2, "b"), (1, "z")] and [tuple(x) for x in first.r] == [(1, "a")]
    assert (first.p, first.q, first.n, tuple(first.f)) == ([9, 2], {"y": 2}, 2, (1, "a"))
    assert [tuple(x) for x in second.u] == [(1, "z")] and (second.n, second.f) == (0, None)


def test_lookup_and_reverse_edges(spark):
    docs = build_profiles(party.BULK, frames(spark))
    asked = spark.createDataFrame([("p1",), ("p1",), ("none",)], "customer_id string")
    assert {r.customer_id: r.found for r in views.lookup(docs, asked, "customer_id").collect()} == {"p1": True, "none": False}
    pointing = views.reverse_edges(build_profiles(party.STREAMED, frames(spark)), "relationships", "party_id_to", "p1")
    assert [r.customer_id for r in pointing.collect()] == ["p3"]


def test_synthetic_tables_keep_their_shares_and_constraints(spark):
    tables = synth.synth_tables(spark, 2000)
    n = {t: df.count() for t, df in tables.items()}
    assert n["customer"] == 2000 and n["customer_identification"] == 0
    assert 2100 < n["customer_address"] < 2320 and 1500 < n["customer_contact"] < 1700
    assert 1740 < n["customer_tax"] < 1860 and 140 < n["relationship"] < 260
    assert checks.violations(tables, party.constraints()).count() == 0
    assert tables["relationship"].where("party_id_from = party_id_to").count() == 0
    again = synth.synth_tables(spark, 2000)
    assert checks.multiset_difference(tables["customer"], again["customer"]).count() == 0
    work = synth.change_workload(spark, 2000, 100)
    assert work.groupBy("op").count().where("op = 'INSERT'").first()["count"] == 30
