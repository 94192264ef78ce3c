"""Keyed table maintenance against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdcgold.operators import changes, merge
from cdcgold.operators.graph import labelled
from cdcgold.spec import ChildSpec

TARGET = [(1, "a", 10, 0), (2, "b", 20, 0), (3, "c", 30, 0)]
COLS = "id int, name string, n int, created int"


def table(spark, rows=TARGET, cols=COLS):
    return spark.createDataFrame(rows, cols)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replace_upsert_and_counts(spark):
    batch = table(spark, [(2, "b", 20, 0), (3, "x", 31, 1), (4, "d", 40, 1)])
    out = merge.replace_upsert(table(spark), batch, ["id"])
    assert rows(out) == [(1, "a", 10, 0), (2, "b", 20, 0), (3, "x", 31, 1), (4, "d", 40, 1)]
    assert tuple(merge.upsert_counts(table(spark), batch, ["id"]).first()) == (1, 1, 1)
    again = merge.replace_upsert(out, batch, ["id"])
    assert rows(again) == rows(out)


def test_patch_sets_only_listed_and_keeps_created(spark):
    patch = table(spark, [(2, "new", None, 9), (5, "e", 50, 9)])
    out = merge.patch_upsert(table(spark), patch, ["id"], ["name", "n"], ["created"])
    assert rows(out) == [(1, "a", 10, 0), (2, "new", None, 0), (3, "c", 30, 0), (5, "e", 50, 9)]
    kept = merge.patch_upsert(table(spark), patch, ["id"], ["name"], insert=False)
    assert rows(kept) == [(1, "a", 10, 0), (2, "new", 20, 0), (3, "c", 30, 0)]


def test_soft_delete_ignores_unknown(spark):
    gone = spark.createDataFrame([(1, 99), (8, 99)], "id int, created int")
    out = merge.soft_delete(table(spark), gone, "id", "name", "created")
    assert rows(out) == [(1, "DELETED", 10, 99), (2, "b", 20, 0), (3, "c", 30, 0)]


def one_by_one(target, batch, keys):
    seen = [{r[k] for r in target} - {None} for k in keys]
    accepted = []
    for r in sorted(batch, key=lambda r: r[-1]):
        if any(r[k] is not None and r[k] in s for k, s in zip(keys, seen)):
            continue
        accepted.append(r)
        for k, s in zip(keys, seen):
            s.add(r[k])
    return sorted(accepted, key=str)


@pytest.mark.parametrize("seed, at_once", [(1, 1 << 20), (2, 1 << 20), (3, 25), (4, 6), (5, 1)])
def test_insert_ignore_against_one_by_one(spark, monkeypatch, seed, at_once):
    """What is left after two rounds is settled at once, component by component, or in more rounds."""
    monkeypatch.setattr(merge, "SETTLE_ROWS", at_once)
    rnd = random.Random(seed)
    pick = lambda n: rnd.choice([None, *range(n)])
    target = [(i, f"r{i + 40}", -1) for i in range(3)]
    batch = [(pick(30), None if (x := pick(60)) is None else f"r{x}", i) for i in range(120)]
    cols = "id int, ref string, pos int"
    got = merge.insert_ignore(table(spark, target, cols), table(spark, batch, cols), ["id", "ref"], "pos")
    assert rows(got) == one_by_one(target, batch, [0, 1])
    single = merge.insert_ignore(table(spark, target, cols), table(spark, batch, cols), ["id"], "pos")
    assert rows(single) == one_by_one(target, batch, [0])


def test_insert_ignore_refused_row_blocks_nobody(spark):
    cols = "id int, ref string, pos int"
    batch = [(1, "A", 0), (1, "B", 1), (2, "B", 2)]
    got = merge.append_ignore(table(spark, [], cols), table(spark, batch, cols), ["id", "ref"], "pos")
    assert rows(got) == [(1, "A", 0), (2, "B", 2)]


def test_insert_ignore_of_a_long_chain(spark):
    """100,000 rows of which each collides with the next: every second one gets in."""
    chain = spark.range(100_000).selectExpr("id div 2 AS id", "concat('r', (id + 1) div 2) AS ref", "id AS pos")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = merge.insert_ignore(chain.limit(0), chain, ["id", "ref"], "pos").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") % 2 == 1).alias("odd")
    ).first()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert tuple(got) == (50_000, 0) and store.executionsCount() - before <= 12


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(8)
    names = rnd.sample(range(10**6), 400)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 260)]
    links += [(names[300], names[300]), (names[310], names[311]), (names[311], names[310])]
    got = labelled(spark.createDataFrame(links, "a long, b long")).collect()
    want = {n: min(names[:151]) for n in names[:151]} | {n: min(names[200:260]) for n in names[200:260]}
    want |= {names[300]: names[300]} | {n: min(names[310:312]) for n in names[310:312]}
    assert {r.node: r.component for r in got} == want


def test_point_updates_last_value_of_each_field(spark):
    updates = spark.createDataFrame(
        [(1, "name", "x", 1, 5), (1, "name", "y", 3, 7), (1, "n", "11", 2, 6), (2, "other", "z", 4, 8), (9, "n", "1", 5, 9)],
        "id int, field string, value string, seq int, created int",
    )
    out = merge.point_updates(table(spark), updates, "id", ["name", "n"], "created")
    assert rows(out) == [(1, "y", 11, 7), (2, "b", 20, 0), (3, "c", 30, 0)]


def test_update_to_null_is_a_value(spark):
    updates = spark.createDataFrame([(1, "name", None, 1)], "id int, field string, value string, seq int")
    assert (1, None, 10, 0) in rows(merge.point_updates(table(spark), updates, "id", ["name"]))


def test_diff_and_filter(spark):
    new = table(spark, [(1, "a", 10, 0), (2, "B", 20, 0), (4, "d", 40, 0)])
    feed = changes.diff(table(spark), new, ["id"])
    assert {(r.id, r.operation) for r in feed.collect()} == {(2, "update"), (3, "delete"), (4, "insert")}
    assert {r.id for r in changes.only(feed, ["delete"]).collect()} == {3}
    assert changes.diff(new, new, ["id"]).count() == 0


CHANGE = st.tuples(st.integers(0, 2), st.integers(0, 3), st.booleans())


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CHANGE, min_size=1, max_size=20), st.integers(0, 20))
def test_patching_arrays_in_any_split_equals_one_by_one(spark, log, cut):
    expected = {0: [(0, -1)], 1: []}
    for pos, (doc, pk, gone) in enumerate(log):
        if doc in expected:
            expected[doc] = [e for e in expected[doc] if e[0] != pk] + ([] if gone else [(pk, pos)])
    docs = spark.createDataFrame([(0, [(0, -1)]), (1, [])], "d int, items array<struct<pk: int, v: int>>")
    child = ChildSpec("t", "pk", "d", "items")
    feed = spark.createDataFrame(
        [(d, pk, i, "delete" if gone else "update", i) for i, (d, pk, gone) in enumerate(log)],
        "d int, pk int, v int, operation string, pos int",
    )
    for part in (feed.where(F.col("pos") < cut), feed.where(F.col("pos") >= cut)):
        docs = changes.patch_arrays(docs, "d", child, part, ["pos"])
    got = {r.d: [tuple(x) for x in r["items"]] for r in docs.collect()}
    assert got == expected
