"""Incremental and stateful folds: splits, replays, restarts and late roots."""

import random
import time

import pandas as pd
import pytest
from party_data import ROWS, Log, address, contact, customer, documents, link
from pyspark.sql import functions as F

from cdcgold.functions.cdc import table_of
from cdcgold.operators.decode import decode, schema_of
from cdcgold.operators.fold import profiles_from_logs
from cdcgold.plans import streams
from cdcgold.session import materialise, scratch, settings, workspace
from cdcgold.sources import party
from cdcgold.sources.topics import RECORD_SCHEMA, stream_files
from cdcgold.sources.wire import from_wire, wire_schema
from cdcgold.spec import ChildSpec, ProfileSpec
from cdcgold.streaming.feed import ChangeApplier
from cdcgold.streaming.incremental import IncrementalProfiles
from cdcgold.streaming.keyed import KeyedTable
from cdcgold.streaming.progress import batches, timed
from cdcgold.streaming.stateful import ROCKSDB, DocumentState, ElementState, _tagged, changed_elements, documents_of, elements_table, fold_stream

SMALL = ProfileSpec(
    root="customer",
    key="customer_id",
    children=(
        ChildSpec("customer_address", "address_id", "customer_id", "addresses", ("address_id", "line1")),
        ChildSpec("relationship", "relationship_id", "party_id_from", "links", ("relationship_id",), "party_id_to"),
    ),
)


def story():
    log = Log().snapshot({t: ROWS[t] for t in ("customer_address", "customer", "relationship")})
    log.add("customer_address", address(1, "p5", line1="moved"))
    log.add("customer_address", address(3, "p2"), "d").raw("customer_address", None, "a3")
    log.raw("customer", "{broken").add("customer", customer(2, first_name="Gone"), "d")
    log.add("relationship", link(1, "p1", "p3")).add("relationship", link(3, "p4", "p4"), "d")
    log.add("customer_address", address(7, "p9", line1="waits")).add("customer", customer(9), "c")
    return log


def batch_fold(spark, log, spec):
    logs = {}
    for t in (spec.root, *(c.table for c in spec.children)):
        good, _ = decode(log.frame(spark).where(table_of("topic") == t), wire_schema(party.SCHEMAS[t]))
        logs[t] = from_wire(good, party.SCHEMAS[t])
    return documents(profiles_from_logs(spec, logs))


@pytest.mark.parametrize(
    "policy",
    [
        {},
        {"root_delete": "drop", "reparent": "move", "direction": "both"},
        {"direction": "both"},
    ],
)
def test_batches_replays_and_duplicates_equal_one_fold(spark, policy):
    spec, log = SMALL.with_(**policy), story()
    # compacting after each batch leaves a base of the very batch that is run again
    every = 1 if policy else None
    engine = IncrementalProfiles(spark, spec, party.SCHEMAS, workspace(spark, "t"), buckets=4, compact_every=every)
    cut = len(log.records) // 2
    first, second = log.records[:cut], log.records[cut:]
    engine.process(log.frame(spark, first), 0)
    # the batch is run again, as after a failure, then the rest comes with old records repeated
    engine.process(log.frame(spark, first), 0)
    engine.compact()
    engine.process(log.frame(spark, second + random.Random(3).sample(first, 5)), 1)
    expected = batch_fold(spark, log, spec)
    assert documents(engine.documents()) == expected
    assert engine.audit().count() == len(log.records)
    assert [r.reason for r in engine.dead_letters().collect()] == ["unparseable value"]
    assert [(r.table, r.reason) for r in engine.findings().collect()] == [("customer", "not json")]
    ends = {r.topic: r.end_offset for r in engine.ledger().groupBy("topic").agg(F.max("end_offset").alias("end_offset")).collect()}
    assert ends["src.party.customer"] == log.offsets["customer"] - 1
    with pytest.raises(ValueError):
        engine.process(log.frame(spark, first), 0)
    engine.compact()
    for table in engine.stored():
        table.vacuum()
        assert table.batches() == []
    assert documents(engine.documents()) == expected


def files_read(spark, since):
    """Files that scans have read in the SQL executions from number ``since`` on, and their number."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList()
    for i in range(since, runs.size()):
        known, run = store.executionMetrics(runs.apply(i).executionId()), runs.apply(i)
        nodes = store.planGraph(run.executionId()).allNodes()
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics()
            for m in range(metrics.size()):
                if metrics.apply(m).name() == "number of files read":
                    value = known.get(metrics.apply(m).accumulatorId())
                    total += int(value.get().split("\n")[-1].split()[0].replace(",", "")) if value.isDefined() else 0
    return total, runs.size()


def test_a_small_batch_reads_no_more_files_after_a_long_history(spark):
    spec = SMALL.with_(reparent="move", direction="both")
    read = []
    for history in (2, 4):
        engine = IncrementalProfiles(spark, spec, party.SCHEMAS, workspace(spark, "t"), buckets=16, compact_every=2)
        log = Log()
        for batch in range(history):
            begin = len(log.records)
            for i in range(30):
                n = 30 * batch + i
                log.add("customer", customer(1, customer_id=f"p{n}")).add("customer_address", address(n % 50, f"p{n}"))
                log.add("relationship", link(n, f"p{n}", f"p{(7 * n) % 60}"))
            engine.process(log.frame(spark, log.records[begin:]), batch)
        begin = len(log.records)
        log.add("customer_address", address(1, "p5")).add("customer_address", address(2, "p5"))
        log.add("relationship", link(1, "p3", "p4")).add("relationship", link(2, "p2", "p9"), "d")
        log.add("customer", customer(4, first_name="Other"))
        log.add("customer_address", address(3, "p77"), "d")
        _, mark = files_read(spark, 1 << 30)
        engine.process(log.frame(spark, log.records[begin:]), history)
        read.append(files_read(spark, mark)[0])
        assert documents(engine.documents()) == batch_fold(spark, log, spec)
    assert 0 < read[1] <= read[0] + 16, read


def seed_tables(spark):
    """Tables to seed, and how many of their rows have been computed."""
    computed = {t: spark.sparkContext.accumulator(0) for t in ("customer", "customer_address", "relationship")}

    def table(name, schema, *rows):
        def count(row, computed=computed[name]):
            computed.add(1)
            return row

        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), schema)

    tables = {
        "customer": table("customer", "customer_id string, first_name string", ("p1", "A"), ("p2", "B")),
        "customer_address": table("customer_address", "address_id string, customer_id string, line1 string", ("a1", "p1", "x")),
        "relationship": table("relationship", "relationship_id string, party_id_from string", ("r1", "p2"), ("r2", "p1")),
    }
    return tables, computed


@pytest.mark.parametrize("policy", [{}, {"reparent": "move"}])
def test_seeding_computes_the_given_tables_once(spark, policy):
    tables, computed = seed_tables(spark)
    engine = IncrementalProfiles(spark, SMALL.with_(**policy), party.SCHEMAS, workspace(spark, "t"), buckets=2)
    engine.seed(tables)
    assert {t: n.value for t, n in computed.items()} == {"customer": 2, "customer_address": 1, "relationship": 2}
    docs = {d.customer_id: ([x.line1 for x in d.addresses], [x.relationship_id for x in d.links]) for d in engine.documents().collect()}
    assert docs == {"p1": (["x"], ["r2"]), "p2": ([], ["r1"])}


def test_a_batch_decodes_the_changes_of_moving_children_once(spark):
    tables, computed = seed_tables(spark)
    engine = IncrementalProfiles(spark, SMALL.with_(reparent="move"), party.SCHEMAS, workspace(spark, "t"), buckets=2)
    first = {"topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(1).cast("bigint"), "__op": F.lit("c")}
    names = [f.name for f in engine._stored("relationship")]
    rows = tables["relationship"].withColumns(first)
    missing = {n: F.lit(None).cast(engine.bronze["relationship"].schema[n].dataType) for n in names if n not in rows.columns}
    engine._store("relationship", rows.withColumns(missing).select(*names), 0)
    assert computed["relationship"].value == 2
    assert engine.bronze_current("relationship").count() == 2 == engine.ends["relationship"].batch(0).count()


def test_failed_batch_is_run_again_by_the_stream(spark):
    log, folder, checkpoint = story(), workspace(spark, "in"), workspace(spark, "cp")
    path = workspace(spark, "t")
    log.frame(spark).coalesce(1).write.parquet(folder)

    class Fails(IncrementalProfiles):
        def process(self, batch, batch_id):
            super().process(batch, batch_id)
            raise RuntimeError("after the writes")

    def run(engine):
        query = engine.start(stream_files(spark, folder), checkpoint, {"availableNow": True})
        query.awaitTermination()

    with pytest.raises(Exception):
        run(Fails(spark, SMALL, party.SCHEMAS, path, buckets=4))
    engine = IncrementalProfiles(spark, SMALL, party.SCHEMAS, path, buckets=4)
    run(engine)
    assert engine.gold().batches() == [0]
    assert documents(engine.documents()) == batch_fold(spark, log, SMALL)


@pytest.mark.parametrize("slices", [1, 3])
def test_stateful_fold_equals_batch_fold(spark, slices):
    log, folder = story(), workspace(spark, "in")
    cut = len(log.records) // 2
    for part in (log.records[:cut], log.records[cut:] + log.records[2:6]):
        log.frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    records = stream_files(spark, folder, files_per_trigger=1)
    logs = {}
    for t in (SMALL.root, *(c.table for c in SMALL.children)):
        good, _ = decode(records.where(table_of("topic") == t), wire_schema(party.SCHEMAS[t]))
        logs[t] = from_wire(good, party.SCHEMAS[t])
    with settings(spark, ROCKSDB):
        docs = fold_stream(SMALL, logs, party.SCHEMAS, slices=slices)
        gold = KeyedTable(spark, workspace(spark, "g"), docs.schema, ["customer_id", "segment"], by="customer_id", buckets=2)
        writer = docs.writeStream.outputMode("update").foreachBatch(gold.append)
        writer.option("checkpointLocation", workspace(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in gold.current().orderBy("segment").collect():
        doc = got.setdefault(r.customer_id, {"first_name": r.first_name, "addresses": [], "links": []})
        doc["addresses"] += [a.asDict() for a in r.addresses]
        doc["links"] += [x.asDict() for x in r.links]
    expected = batch_fold(spark, log, SMALL)
    assert set(got) == set(expected)
    for key, doc in got.items():
        assert doc["first_name"] == expected[key]["first_name"]
        assert sorted(doc["addresses"], key=str) == expected[key]["addresses"]
        assert sorted(doc["links"], key=str) == expected[key]["links"]


def test_removed_elements_are_remembered_for_their_time(spark):
    """A late record of a removed element is ignored at first, and is a new one when the time is over."""
    folder, checkpoint = workspace(spark, "in"), workspace(spark, "cp")
    gold = elements_table(spark, workspace(spark, "g"), buckets=2)

    def run(log, first, remember_ms=1 << 40):
        log.frame(spark, log.records[first:]).coalesce(1).write.mode("append").parquet(folder)
        records, logs = stream_files(spark, folder), {}
        for t in (SMALL.root, *(c.table for c in SMALL.children)):
            good, _ = decode(records.where(table_of("topic") == t), wire_schema(party.SCHEMAS[t]))
            logs[t] = from_wire(good, party.SCHEMAS[t])
        seen = []
        with settings(spark, ROCKSDB):
            changes = changed_elements(SMALL, logs, remember_ms=remember_ms)

            def keep(batch, batch_id):
                gold.append(batch, batch_id)
                seen.extend((r.array, r.pk, r.gone) for r in batch.collect())

            writer = changes.writeStream.outputMode("update").foreachBatch(keep)
            writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    log = Log().add("customer", customer(1)).add("customer_address", address(1, "p1")).add("customer_address", address(2, "p1"))
    early = list(log.records)
    log.add("customer_address", address(1, "p1"), "d")
    assert run(log, 0, 30_000) == [("", "p1", False), ("addresses", "a1", True), ("addresses", "a2", False)]
    log.records += early  # delivered again
    ended = time.time()
    assert run(log, len(early) + 1, 30_000) == [("", "p1", False), ("addresses", "a2", False)]
    docs = documents_of(SMALL, party.SCHEMAS, gold.current()).collect()
    assert [[a.address_id for a in d.addresses] for d in docs] == [["a2"]]
    time.sleep(max(0.0, ended + 31 - time.time()))
    again = len(log.records)
    log.records += early[1:2]
    assert run(log, again, 30_000) == [("addresses", "a1", False)]
    current = gold.current().where("pk = 'a1'").collect()
    assert [r.gone for r in current] == [True], "the table's own positions still tell the older row"


def test_positions_of_removed_elements_do_not_pile_up(spark):
    """Elements come and go; what is remembered of them stays within the lateness."""
    child = ChildSpec("item", "k", "id", "items", ("k", "v"))
    docs = KeyedTable(
        spark, workspace(spark, "g"), schema_of("id long, items array<struct<k: long, v: long>>"), ["id"], by="id",
        whole=True, buckets=2,
    )
    docs.append(spark.createDataFrame([(1, [])], "id long, items array<struct<k: long, v: long>>"), -1)
    applier = ChangeApplier(docs, "id", [child], {"items": lambda b: b}, ["pos"], lateness=60, compact_every=2)
    feed = "id long, k long, v long, operation string, pos long"
    sizes = []
    for batch in range(4):
        rows, at = [], 100 * batch
        for i in range(50):
            rows += [(1, at + i, i, "insert", 2 * (at + i)), (1, at + i, i, "delete", 2 * (at + i) + 1)]
        rows[-1] = (1, 7, batch, "update", 2 * (at + 50))  # the last element stays, and 7 comes back
        if batch == 3:
            rows.append((1, 1, 0, "insert", 0))  # far too late
            rows.append((1, 340, 9, "insert", 680))  # removed later in the same batch
        applier.process(spark.createDataFrame(rows, feed).repartition(3), batch)
        sizes.append(applier.applied.current().count())
    [doc] = docs.current().collect()
    assert [(e.k, e.v) for e in doc["items"]] == [(49, 49), (149, 49), (249, 49), (349, 49), (7, 3)]
    assert sizes[3] <= sizes[1] + 2 < 100 and sizes[0] == 50, sizes


def test_keyed_table_ignores_uncommitted_folders(spark):
    schema = schema_of("id int, v string")
    path = workspace(spark, "k")
    table = KeyedTable(spark, path, schema, ["id"], by="id", buckets=2)
    assert table.current().count() == 0
    table.append(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    table.append(spark.createDataFrame([(2, "c")], schema), 1)
    # a folder without its commit marker is a write that did not end
    spark.createDataFrame([(3, "x")], schema).withColumn("batch_id", F.lit(2).cast("bigint")).withColumn(
        "_bucket", F.lit(0)
    ).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("_bucket").parquet(f"{path}/batch=2")
    assert {(r.id, r.v) for r in table.current().collect()} == {(1, "a"), (2, "c")}
    some = table.current(spark.createDataFrame([(2,)], "id int"))
    assert [(r.id, r.v) for r in some.collect()] == [(2, "c")]


def test_contact_records_have_schema(spark):
    log = Log().add("customer_contact", contact(1, "p1"))
    assert log.frame(spark).schema == schema_of(RECORD_SCHEMA)


def test_composite_keys_stay_apart_and_null_keys_are_skipped(spark):
    rows = [("r", "a|b", "c"), ("r", "a", "b|c"), ("r", None, "c"), (None, "a", "b")]
    log = spark.createDataFrame(rows, "fk string, x string, y string").withColumns({"partition": F.lit(0), "offset": F.lit(1)})
    keys = [r.pk for r in _tagged(log, "fk", "items", ("x", "y")).collect()]
    assert len(keys) == 2 and len(set(keys)) == 2


def test_scratch_folders_go_and_the_result_stays(spark):
    with scratch(spark) as keep:
        inner = materialise(spark.range(5), "inner")
        files = inner.inputFiles()
        out = keep(inner.selectExpr("id + 1 AS id"), "out")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()


def test_batches_are_timed_by_the_query(spark):
    log, folder = story(), workspace(spark, "records")
    engine = IncrementalProfiles(spark, SMALL, party.SCHEMAS, workspace(spark, "t"), buckets=2)
    log.frame(spark, log.records[:5]).coalesce(1).write.mode("append").parquet(folder)
    begun = int(time.time() * 1000)
    query = engine.start(
        stream_files(spark, folder, files_per_trigger=1), workspace(spark, "checkpoint"), {"processingTime": "1 second"}
    )
    try:
        query.processAllAvailable()
        # records that come later wait for the trigger
        log.frame(spark, log.records[5:]).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    ended = int(time.time() * 1000)
    reports = batches(spark, query)
    rows = {r["batch_id"]: r for r in reports.collect()}
    assert {b: r["n_records"] for b, r in rows.items()} == {0: 5, 1: len(log.records) - 5}
    # a batch does not start before the one ahead of it has ended
    assert begun - 1000 <= rows[0]["started_ms"] <= rows[0]["done_ms"] <= rows[1]["started_ms"] <= rows[1]["done_ms"] <= ended + 1000
    ledger = timed(engine.ledger(), reports)
    assert ledger.count() == engine.ledger().count()
    assert {(r["batch_id"], r["gold_ms"]) for r in ledger.collect()} == {(b, r["done_ms"]) for b, r in rows.items()}
    assert timed(engine.ledger(), reports.where("batch_id = 0")).where("batch_id = 1").isEmpty()


class Asked:
    """A state value that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_a_group_of_elements_asks_the_state_twice_a_batch():
    state, known = ElementState(remember_ms=10), Asked()
    state.init(known)
    names = ["doc", "slice", "array", "pk", "part", "pos", "gone", "payload"]

    def batch(ms, *rows):
        frames = [pd.DataFrame([r], columns=names) for r in rows]
        return [tuple(r) for f in state.handleInputRows((0,), iter(frames), At(ms)) for r in f.itertuples(index=False)]

    first = [("d|é", i % 2, "items", str(i), 0, i, i == 7, "{}") for i in range(300)]
    assert batch(0, *first) == first and known.calls == 2
    assert batch(1, *first) == first, "delivered again"
    older = [(*r[:5], -1, False, "{}") for r in first]
    assert batch(2, *older) == [] and known.calls == 5
    # the removal is forgotten after its time, counted from its last delivery
    assert batch(10, *older) == [] and batch(11, *older) == [older[7]]


def test_parts_are_landed_as_files_of_bounded_size_and_one_batch_each(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    log = spark.range(1000, numPartitions=20).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"),
        F.lit("v").alias("value"), F.timestamp_seconds("id").alias("timestamp"),
    )
    (first, *rest), files = streams._parts(log)
    assert files == 7
    folder, seen = workspace(spark, "records"), []
    for part in (first, *rest):
        streams._land(part, folder, files)
    assert spark.read.parquet(folder).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 100

    def keep(batch, batch_id):
        seen.append(batch.agg(F.min("offset"), F.max("offset"), F.count("offset")).first())

    writer = stream_files(spark, folder, files_per_trigger=files).writeStream.foreachBatch(keep)
    writer.option("checkpointLocation", workspace(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in seen] == [(0, 333, 334), (334, 666, 333), (667, 999, 333)]


def test_parts_of_the_log_are_read_by_bounds(spark):
    log = streams.raw_records(spark, "/root/testdata/sf0.001")
    parts = streams._ranges(log)
    plan = parts[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id" in plan and "LessThan(event_id" in plan
    end = log.agg(F.max("offset") + 1).first()[0]
    for i, part in enumerate(parts):
        assert part.exceptAll(log.where(F.expr(f"offset * 3 div {end} = {i}"))).isEmpty()
    assert sum(p.count() for p in parts) == log.count()


def test_partitions_of_the_log_make_no_micro_batches(spark):
    directory = "/root/testdata/sf0.001"
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}):
        folder, files = streams._landed(spark, directory)
    assert files == 1 and len(spark.read.parquet(folder).inputFiles()) == 4


def test_a_group_of_documents_asks_the_state_twice_a_batch():
    state, held = DocumentState(), Asked()
    state.init(held)
    names = ["doc", "slice", "array", "pk", "part", "pos", "gone", "payload"]

    def batch(*rows):
        frames = state.handleInputRows((0,), iter([pd.DataFrame(list(rows), columns=names)]), None)
        return {d: (root, gone, [e["payload"] for e in items]) for f in frames for d, _, root, gone, items in f.itertuples(index=False)}

    def items(doc, pos=1):
        return [(doc, 0, "items", str(i), 0, pos, False, f"{doc}{i}") for i in range(100)]

    assert batch(*items("a"), *items("b"), ("b", 0, "", "b", 0, 1, False, "root")) == {
        "b": ("root", False, [r[7] for r in items("b")])
    }
    assert held.calls == 2
    # a document is given when it changes; an older row changes nothing, a removed one goes
    changed = batch(("a", 0, "", "a", 0, 2, False, "late"), ("a", 0, "items", "0", 0, 0, True, ""), ("a", 0, "items", "1", 0, 2, True, ""))
    assert changed == {"a": ("late", False, ["a0", *(r[7] for r in items("a")[2:])])} and held.calls == 4
