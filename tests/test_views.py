"""Views kept by counts: equal to a recomputation after any changes, and reading no more than they need."""

import random

from pyspark.sql import functions as F

from cdcgold.operators.changes import diff
from cdcgold.session import workspace
from cdcgold.streaming.counted import COUNT, NewestView, by_edge, by_field
from cdcgold.streaming.keyed import KeyedTable

DOCS = "id bigint, status string, updated bigint, edges array<struct<to: bigint>>"
DAY = 86_400_000


def some(rng, i):
    edges = [(rng.randrange(5),) for _ in range(rng.randrange(4))]
    return (i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(9 * DAY)]), edges)


def recomputed(state):
    statuses, pairs = {}, {}
    for i, status, _, edges in state.values():
        if status is not None:
            statuses[status] = statuses.get(status, 0) + 1
        for (to,) in edges:
            pairs[to, i] = pairs.get((to, i), 0) + 1
    times = sorted((-d[2], d[0]) for d in state.values() if d[2] is not None)
    return statuses, pairs, [(i, -t) for t, i in times[:3]]


def found(status, edges, newest):
    return (
        {r["status"]: r[COUNT] for r in status.counts().collect()},
        {(r["to"], r["id"]): r[COUNT] for r in edges.counts().collect()},
        [tuple(r) for r in newest.newest(3).collect()],
    )


def test_views_equal_a_recomputation(spark):
    status = by_field(spark, workspace(spark, "status"), "status", buckets=2)
    edges = by_edge(spark, workspace(spark, "edges"), "id", "edges", "to", buckets=2)
    newest = NewestView(spark, workspace(spark, "newest"), "id", "updated", buckets=2)
    views = [status, edges, *newest.views()]
    rng, state = random.Random(5), {}
    assert found(status, edges, newest) == ({}, {}, [])
    for batch in range(4):
        touched = rng.sample(range(12), 7)
        before = {i: state[i] for i in touched if i in state}
        after = {i: some(rng, i) for i in touched if rng.random() < 0.7}
        state = {i: d for i, d in state.items() if i not in touched} | after
        old, new = (spark.createDataFrame(list(x.values()), DOCS) for x in (before, after))
        for view in views:
            if batch % 2:
                view.take_feed(diff(old, new, ["id"]).select(
                    F.when(F.col("before").isNotNull(), F.struct("id", "before.*")).alias("before"),
                    F.when(F.col("after").isNotNull(), F.struct("id", "after.*")).alias("after"),
                ), batch)
            else:
                view.apply(old, new, batch)
            if batch == 2:  # run again, as after a failure
                view.apply(old, new, batch)
            if batch == 1:
                view.compact()
        assert found(status, edges, newest) == recomputed(state)
    some_ends = spark.createDataFrame([(1,), (1,), (77,)], "to bigint")
    assert {r["to"] for r in edges.counts(some_ends).collect()} == {to for to, _ in recomputed(state)[1] if to == 1}
    assert edges.table.rows().where(f"{COUNT} < 0").isEmpty()


def test_compacting_forgets_what_is_gone(spark):
    view = by_field(spark, workspace(spark, "status"), "status", buckets=2)
    one, none = spark.createDataFrame([(1, "a", 1, [])], DOCS), spark.createDataFrame([], DOCS)
    view.apply(none, one, 0)
    view.apply(one, none, 1)
    assert view.table.current().count() == 1 and view.counts().isEmpty()
    view.compact()
    assert view.table.current().isEmpty()


def test_a_batch_reads_the_buckets_of_its_changes(spark, monkeypatch):
    view = by_edge(spark, workspace(spark, "edges"), "id", "edges", "to", buckets=16)
    docs = spark.createDataFrame([(i, "a", 1, [(i,)]) for i in range(64)], DOCS)
    view.apply(docs.limit(0), docs, 0)
    seen, real = [], KeyedTable.buckets_of
    monkeypatch.setattr(KeyedTable, "buckets_of", lambda self, t: seen.append(real(self, t)) or seen[-1])
    one = docs.where("id = 3")
    # the status of the document changes, its edges do not: nothing is read or written
    view.apply(one, one.withColumn("status", F.lit("b")), 1)
    view.apply(one, one.withColumn("edges", F.array(F.struct(F.lit(9).cast("bigint").alias("to")))), 2)
    assert len(seen[0]) == 0 and 1 <= len(seen[1]) <= 2
    assert view.table.batch(1).isEmpty() and view.table.batch(2).count() == 2
