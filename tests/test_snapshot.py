"""Chunks read while a log runs, against the state of the table at the end."""

import random

import pytest
from pyspark.sql import functions as F

from cdcgold.operators.latest import latest, live
from cdcgold.operators.snapshot import PHASE, merge_chunks, read_chunks

COLUMNS = "id long, v long, __op string, __deleted string, pos long"


def history(rnd, n):
    """Changes of few keys, deletes and re-inserts among them."""
    return [(rnd.randrange(12), i, op, str(op == "d").lower(), i) for i in range(n) if (op := rnd.choice("cuud"))]


def state(changes, upto):
    rows = {c[0]: c for c in changes if c[4] <= upto}
    return {k: c[1] for k, c in rows.items() if c[2] != "d"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_chunks_end_in_the_tables_state(spark, seed):
    rnd = random.Random(seed)
    changes = history(rnd, 200)
    start = 100
    chunks, now = [], start
    order = [0, 1, 2, 3]
    rnd.shuffle(order)
    for n, part in enumerate(order):
        low = now
        seen = low + rnd.randrange(12)
        high = now = seen + rnd.randrange(12)
        chunks += [(k, v, n, low, high) for k, v in state(changes, seen).items() if k % 4 == part]
    log = spark.createDataFrame([c for c in changes if c[4] > start], COLUMNS)
    read = spark.createDataFrame(chunks, "id long, v long, chunk int, low long, high long")
    merged = merge_chunks(log, read.withColumn("low", F.col("low")), ["id"], "pos")
    rows = merged.orderBy("pos", PHASE).collect()
    applied = {}
    for r in rows:  # as a sink does that knows no positions
        before = applied.get(r.id, -1)
        assert r[PHASE] == 0 or before <= r.v, "a chunk's row went over a newer one"
        applied[r.id] = r.v if r["__op"] != "d" else -1
    assert {k: v for k, v in applied.items() if v >= 0} == state(changes, 999)
    final = live(latest(merged, ["id"], ["pos", PHASE])).collect()
    assert {r.id: r.v for r in final} == state(changes, 999)


def test_chunks_of_nothing(spark):
    log = spark.createDataFrame([(1, 5, "c", "false", 7)], COLUMNS)
    ends = iter([7, 7, 8, 8])
    chunks = read_chunks([0, 1], lambda part: spark.createDataFrame([], "id long, v long"), lambda: next(ends))
    assert [r.id for r in merge_chunks(log, chunks, ["id"], "pos").collect()] == [1]
