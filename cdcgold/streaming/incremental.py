"""Documents kept up to date batch by batch, with the same plans as the bulk build.

Each micro-batch is decoded, kept for audit, merged into per-table bronze tables, and the
documents of the parents it touched are rebuilt and replaced in gold.

Where a child may change its parent, or has two, bronze is kept by child, and a reverse index by
document key beside it: a copy of the child under each of its ends, and a mark under each end that
it has left.  Both are kept up to date from the batch's changes and the places the changed
children had before, so a batch reads the buckets of what it changes and no more.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.functions.cdc import table_of
from cdcgold.operators.decode import decode, flat_schema, schema_of
from cdcgold.operators.diagnosis import UNKNOWN_TABLE, diagnose
from cdcgold.operators.fold import build_profiles
from cdcgold.operators.latest import LOG_ORDER, current_child, current_root, latest, live
from cdcgold.session import materialise, scratch
from cdcgold.sources.topics import RECORD_SCHEMA, once
from cdcgold.sources.wire import from_wire, wire_schema
from cdcgold.spec import ChildSpec, ProfileSpec
from cdcgold.streaming.counted import CountedView
from cdcgold.streaming.keyed import KeyedTable, read_batches, write_batch

_POSITION = "topic string, partition int, offset bigint"
_RECORD = ("topic", "partition", "offset", "key", "value", "timestamp")
GONE = "_gone"
# Columns of the reverse index: digest of the child's identity, its ends; the end a row is kept
# under, whether the child has left it.
ID, ENDS, END, LEFT = "_id", "_ends", "_end", "_left"


def _now_ms() -> int:
    return int(time.time() * 1000)


class IncrementalProfiles:
    """State under ``path``: audit/, dead_letters/, bronze/<table>/, ends/<table>/, gold/, ledger/.

    ``compact_every``: fold every table into one base after so many batches, and remove what the
    base before it had replaced; None leaves both to the caller.
    ``views`` are kept up to date with the documents, from their states before and after each batch.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: ProfileSpec,
        schemas: Mapping[str, str | T.StructType],
        path: str,
        *,
        buckets: int = 64,
        compact_every: int | None = 16,
        views: Sequence[CountedView] = (),
    ):
        self.spark, self.spec, self.path, self.buckets = spark, spec, path.rstrip("/"), buckets
        self.compact_every, self.views = compact_every, list(views)
        self.schemas = {t: schema_of(schemas[t]) for t in self.tables}
        self.bronze = {t: self._bronze(t) for t in self.tables}
        self.ends = {c.table: self._by_end(c) for c in spec.children if self._indexed(c)}
        self._gold: KeyedTable | None = None

    @property
    def tables(self) -> list[str]:
        return [self.spec.root, *(c.table for c in self.spec.children)]

    def _child(self, table: str) -> ChildSpec | None:
        return next((c for c in self.spec.children if c.table == table), None)

    def _keys(self, table: str) -> list[str]:
        child = self._child(table)
        if child is None:
            return [self.spec.key]
        if self.spec.reparent == "move":
            return list(child.pk)
        return [child.fk, *(k for k in child.pk if k != child.fk)]

    def _indexed(self, child: ChildSpec) -> bool:
        """Can a row change its parents without changing its key?"""
        return self.spec.reparent == "move" or self._two_ended(child)

    def _stored(self, table: str) -> list[T.StructField]:
        return schema_of(_POSITION).fields + flat_schema(self.schemas[table]).fields

    def _bronze(self, table: str) -> KeyedTable:
        """Rows by parent; by the digest of their own identity where an index by parent is kept."""
        child = self._child(table)
        by = self.spec.key if child is None else child.fk
        fields = self._stored(table)
        if child is not None and self._indexed(child):
            by = ID
            fields += [T.StructField(ID, T.LongType()), T.StructField(ENDS, T.ArrayType(self._key_type()))]
        return KeyedTable(
            self.spark, f"{self.path}/bronze/{table}", T.StructType(fields), self._keys(table),
            by=by, order=LOG_ORDER, buckets=self.buckets,
        )

    def _by_end(self, child: ChildSpec) -> KeyedTable:
        """The reverse index: a child's newest row under each end, or that it has left the end."""
        own = [T.StructField(END, self._key_type()), T.StructField(LEFT, T.BooleanType())]
        keys = [END, *self._keys(child.table)]
        return KeyedTable(
            self.spark, f"{self.path}/ends/{child.table}", T.StructType(self._stored(child.table) + own), keys,
            by=END, order=LOG_ORDER, buckets=self.buckets,
        )

    def _key_type(self) -> T.DataType:
        return self.schemas[self.spec.root][self.spec.key].dataType

    def gold(self, schema: T.StructType | None = None) -> KeyedTable:
        """The documents' table; its schema is that of the first build."""
        if self._gold is None:
            if schema is None:
                nobody = self.spark.createDataFrame([], self._key_schema())
                schema = build_profiles(self.spec, self._current(nobody)).schema
            gone = T.StructField(GONE, T.BooleanType())
            self._gold = KeyedTable(
                self.spark, f"{self.path}/gold", T.StructType([*schema.fields, gone]), [self.spec.key],
                by=self.spec.key, whole=True, buckets=self.buckets,
            )
        return self._gold

    def _key_schema(self) -> T.StructType:
        return T.StructType([self.schemas[self.spec.root][self.spec.key]])

    def documents(self) -> DataFrame:
        """Current documents of all keys."""
        return self.gold().current().where(~F.col(GONE)).drop(GONE, "batch_id")

    def documents_of(self, keys: DataFrame) -> DataFrame:
        """Current documents of some keys; only the files of their buckets are read."""
        return self.gold().current(materialise(keys, "asked")).where(~F.col(GONE)).drop(GONE, "batch_id")

    def audit(self) -> DataFrame:
        """Raw records as taken in, once per coordinate."""
        schema = schema_of(f"{RECORD_SCHEMA}, ingested_at timestamp, table string")
        raw = read_batches(self.spark, f"{self.path}/audit", schema)
        return raw.dropDuplicates(["topic", "partition", "offset"])

    def timed_audit(self) -> DataFrame:
        """The audit with the source time of each record; null where the record has none."""
        paths = [F.get_json_object("value", f"$.{p}__source_ts_ms") for p in ("", "payload.")]
        return self.audit().withColumn("__source_ts_ms", F.coalesce(*paths).try_cast("bigint"))

    def bronze_current(self, table: str) -> DataFrame:
        """One row per primary key, the newest in log order, without deleted ones.

        A fold that keeps moved children with their old parents stores them per parent; here a
        moved child is there once, with its newest parent.
        """
        child = self._child(table)
        keys = [self.spec.key] if child is None else list(child.pk)
        return live(latest(self.bronze[table].rows(), keys)).drop("batch_id", ID, ENDS)

    def seed(self, tables: Mapping[str, DataFrame], batch_id: int = -1) -> None:
        """Bulk load of current rows ahead of every record; the log may then replay any part of them.

        Running it again replaces what it wrote, as long as no record has been processed.
        """
        with scratch(self.spark):
            self._seed(tables, batch_id)

    def _seed(self, tables: Mapping[str, DataFrame], batch_id: int) -> None:
        rows = {}
        for t in self.tables:
            names = [f.name for f in self._stored(t)]
            first = {"topic": F.lit(""), "partition": F.lit(-1), "offset": F.lit(-1).cast("bigint"), "__op": F.lit("r")}
            first |= {"__deleted": F.lit("false"), "__table": F.lit(t)}
            given = tables[t]
            none = {n: F.lit(None).cast(self.bronze[t].schema[n].dataType) for n in names if n not in given.columns}
            rows[t] = given.withColumns(none | {k: v for k, v in first.items() if k in names}).select(*names)
        self._together([partial(self._store, t, r, batch_id) for t, r in rows.items()])
        # what was stored is read again, so the given tables are computed once
        rows = {t: self.bronze[t].batch(batch_id).select(*r.columns) for t, r in rows.items()}
        current = {c.table: current_child(self.spec, c, rows[c.table]) for c in self.spec.children}
        current[self.spec.root] = current_root(self.spec, rows[self.spec.root])
        docs = build_profiles(self.spec, current)
        self.gold(docs.schema).append(docs.withColumn(GONE, F.lit(False)), batch_id)
        self._keep_views(None, batch_id)

    def dead_letters(self) -> DataFrame:
        schema = schema_of(f"{RECORD_SCHEMA}, reason string")
        return read_batches(self.spark, f"{self.path}/dead_letters", schema)

    def findings(self) -> DataFrame:
        """What is wrong with each dead letter: table, field and what it holds."""
        keys = {t: [self.spec.key] if (c := self._child(t)) is None else list(c.pk) for t in self.tables}
        return diagnose(self.dead_letters(), {t: wire_schema(self.schemas[t]) for t in self.tables}, keys)

    def ledger(self) -> DataFrame:
        """Per batch and log partition, how far the documents are and when that became visible."""
        schema = schema_of("topic string, partition int, end_offset bigint, bronze_ms bigint, gold_ms bigint")
        return read_batches(self.spark, f"{self.path}/ledger", schema)

    def _two_ended(self, child: ChildSpec) -> bool:
        return self.spec.direction == "both" and child.other_fk is not None

    def _store(self, table: str, newest: DataFrame, batch_id: int) -> None:
        """Add the newest rows of a batch, one per key, to bronze and to the reverse index."""
        child = self._child(table)
        if child is None or not self._indexed(child):
            self.bronze[table].append(newest, batch_id)
            return
        keys = self._keys(table)
        ends = [child.fk, child.other_fk] if self._two_ended(child) else [child.fk]
        ends = F.array_distinct(F.array_compact(F.array(*(F.col(e).cast(self._key_type()) for e in ends))))
        changed = newest.dropna(subset=keys).withColumns({ID: F.xxhash64(*keys), ENDS: ends})
        # asked for its buckets, for its places and for its rows: decoded and ranked once
        changed = materialise(changed, f"changed-{table}")
        places = self.bronze[table].current(changed.select(ID).distinct(), before=batch_id)
        old = [F.col(c).alias(f"_old{c}") for c in (*LOG_ORDER, ENDS)]
        placed = changed.join(places.select(*keys, *old), keys, "left")
        # a record older than what is known changes nothing
        known, now = (F.struct(*(f"{p}{c}" for c in LOG_ORDER)) for p in ("_old", ""))
        placed = materialise(placed.where(F.col(f"_old{ENDS}").isNull() | (now >= known)), f"placed-{table}")
        self.bronze[table].append(placed.select(*changed.columns), batch_id)
        names = [f.name for f in self._stored(table)]
        here = placed.select(*names, F.explode(ENDS).alias(END), F.lit(False).alias(LEFT))
        left = placed.select(*names, F.explode(F.array_except(f"_old{ENDS}", ENDS)).alias(END), F.lit(True).alias(LEFT))
        self.ends[table].append(here.unionByName(left), batch_id)

    def _touched(self, batch_id: int) -> DataFrame:
        """Keys whose document the batch may have changed, each once, as a written table."""
        keys = []
        for t in self.tables:
            child, key = self._child(t), self.spec.key
            if child is not None and self._indexed(child):
                keys.append(self.ends[t].batch(batch_id).select(F.col(END).alias(key)))
            else:
                by = key if child is None else child.fk
                keys.append(self.bronze[t].batch(batch_id).select(F.col(by).alias(key)))
        return materialise(reduce(DataFrame.unionByName, keys).dropna().distinct(), "touched")

    def _current(self, touched: DataFrame) -> dict[str, DataFrame]:
        """Current rows of the touched documents, per table."""
        root = self.bronze[self.spec.root]
        wanted = root.buckets_of(touched)
        out = {self.spec.root: current_root(self.spec, root.current(touched, wanted))}
        for child in self.spec.children:
            if self._indexed(child):
                rows = self.ends[child.table].current(touched, wanted).where(~F.col(LEFT))
                rows = rows.dropDuplicates(self._keys(child.table)).drop(END, LEFT)
            else:
                rows = self.bronze[child.table].current(touched, wanted)
            out[child.table] = current_child(self.spec, child, rows)
        return out

    def _keep_views(self, touched: DataFrame | None, batch_id: int) -> None:
        """Views take in the documents that a batch has written, as they were and as they are."""
        if self.views:
            gold = self.gold()
            states = gold.current(touched, before=batch_id), gold.batch(batch_id)
            before, after = (s.where(~F.col(GONE)) for s in states)
            self._together([partial(v.apply, before, after, batch_id) for v in self.views])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch; running it again with the same id gives the same tables."""
        with scratch(self.spark):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        stamped = batch.select(*_RECORD, F.current_timestamp().alias("ingested_at"))
        stamped = stamped.withColumn("table", F.coalesce(table_of("topic"), F.lit("")))
        raw = write_batch(stamped, f"{self.path}/audit", batch_id, by=["table"])
        writes, rejected = [], []
        for table in self.tables:
            mine = raw.where(F.col("table") == table)
            good, bad = decode(mine, wire_schema(self.schemas[table]))
            newest = latest(from_wire(good, self.schemas[table]), self._keys(table))
            writes.append(partial(self._store, table, newest, batch_id))
            rejected.append(bad)
        unrouted = raw.where(~F.col("table").isin(*self.tables)).withColumn("reason", F.lit(UNKNOWN_TABLE))
        rejected.append(unrouted.select(*rejected[0].columns))
        dead = reduce(DataFrame.unionByName, rejected)
        writes.append(partial(write_batch, dead, f"{self.path}/dead_letters", batch_id))
        self._together(writes)
        bronze_ms = _now_ms()

        touched = self._touched(batch_id)
        tables = self._current(touched)
        docs = build_profiles(self.spec, tables)
        gone = touched.join(tables[self.spec.root].select(self.spec.key), self.spec.key, "left_anti")
        rows = docs.withColumn(GONE, F.lit(False)).unionByName(
            gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True
        )
        self.gold(docs.schema).append(rows, batch_id)
        self._keep_views(touched, batch_id)

        upto = raw.groupBy("topic", "partition").agg(F.max("offset").alias("end_offset"))
        times = [F.lit(bronze_ms).alias("bronze_ms"), F.lit(_now_ms()).alias("gold_ms")]
        write_batch(upto.select("*", *times), f"{self.path}/ledger", batch_id)
        if self.compact_every and batch_id % self.compact_every == self.compact_every - 1:
            self.compact()
            for table in self.stored():
                table.vacuum(keep=1)

    def _together(self, writes: list) -> None:
        """Independent writes as concurrent jobs, so small tables do not wait for each other."""
        with ThreadPoolExecutor(len(writes)) as pool:
            list(pool.map(lambda write: write(), [inheritable_thread_target(self.spark)(w) for w in writes]))

    def stored(self) -> list[KeyedTable]:
        return [*self.bronze.values(), *self.ends.values(), self.gold(), *(v.table for v in self.views)]

    def compact(self) -> None:
        views = [v.table for v in self.views]
        for kept in [*(t for t in self.stored() if t not in views), *self.views]:
            kept.compact()

    def start(
        self, records: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None = None,
        within: str | None = None,
    ):
        """Run over a stream of records; restarts continue from the checkpoint.

        ``within``: drop records delivered again before they are worked on (see ``topics.once``).
        """
        records = records if within is None else once(records, within)
        writer = records.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
