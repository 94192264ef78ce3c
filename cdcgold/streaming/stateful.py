"""The fold as one stateful operator over all tables of the document.

They share one stream of (key, slice, array, pk, position, gone, payload).  Payloads are JSON
text, so the Python part only compares positions; parsing, typing and ordering happen in Spark.

``changed_elements`` keeps positions alone and emits the elements that changed: a batch costs the
groups of elements that it changes, however large the documents are.  Positions of removed elements expire.
``fold_stream`` keeps the payloads as well and emits whole documents, for sinks that replace them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cdcgold.functions.cdc import is_deleted, strip_metadata
from cdcgold.functions.values import slot
from cdcgold.operators.decode import schema_of
from cdcgold.spec import ProfileSpec
from cdcgold.streaming.keyed import KeyedTable

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # expiry by processing time asks for another batch for ever; without data it can wait
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_ROOT = ""
_OUTPUT = (
    "_key string, segment int, root string, gone boolean,"
    " items array<struct<array: string, payload: string>>"
)
_OUTPUT_NAMES = ["_key", "segment", "root", "gone", "items"]


# Columns of the frames that Python sees; names with a leading underscore would not reach it.
_ROW = ("doc", "slice", "array", "pk", "part", "pos", "gone", "payload")
_ELEMENT_NAMES = ["_key", "segment", *_ROW[2:]]
_ELEMENT = "_key string, segment int, array string, pk string, part int, pos bigint, gone boolean, payload string"
#: How long a removed element is remembered: a record older than the removal is ignored for so long.
REMEMBER_MS = 7 * 24 * 3600 * 1000
#: Groups whose positions are one value of state each.
GROUPS = 1 << 12
ELEMENT_GROUP = ("doc", "slice", "array", "pk")
DOCUMENT_GROUP = ("doc", "slice")


def _newest(frames: Iterator[pd.DataFrame]) -> dict[tuple, tuple]:
    """The newest row of each element, in the order of ``_ROW``; of equal positions the last."""
    newest: dict[tuple, tuple] = {}
    for frame in frames:
        for row in zip(*(frame[c].tolist() for c in _ROW), strict=True):
            name = row[:4]
            if name not in newest or newest[name][4:6] <= row[4:6]:
                newest[name] = row
    return newest


def _loaded(state) -> list[list]:
    held = state.get()
    return [] if held is None else json.loads(held[0])


def _store(state, entries: Iterable[list]) -> None:
    state.update((json.dumps(list(entries), ensure_ascii=False, separators=(",", ":")),))


class ElementState(StatefulProcessor):
    """The position last applied to each element of a group; newer changes pass.

    A group is a share of all elements by digest.  Its positions are one state value, so a batch asks
    the state store twice a group, not several times an element.  Removed elements are forgotten after
    their time, when their group changes next.  Roots are not: a document without its root is not
    shown, so there is nothing to forget.
    """

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "elements string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, newest = timerValues.getCurrentProcessingTimeInMs(), _newest(rows)
        known = {tuple(e[:4]): e for e in _loaded(self._known) if e[6] is None or now < e[6] + self.remember_ms}
        changed = []
        for name, row in newest.items():
            at, (array, gone) = known.get(name), (row[2], row[6])
            if at is None or (at[4], at[5]) <= row[4:6]:
                known[name] = [*row[:6], now if gone and array != _ROOT else None]
                changed.append(row)
        if changed:
            _store(self._known, known.values())
            yield pd.DataFrame(changed, columns=_ELEMENT_NAMES)

    def close(self) -> None:
        pass


class DocumentState(StatefulProcessor):
    """Root row and child rows of each document slice of a group, each with the position it came from.

    A row older than the one held is ignored, and a removed row leaves its position behind,
    so records delivered again change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = _newest(rows)
        held = {tuple(e[:4]): e for e in _loaded(self._held)}
        for name, row in newest.items():
            if name not in held or tuple(held[name][4:6]) <= row[4:6]:
                held[name] = list(row)
        _store(self._held, held.values())
        roots, items = {}, {name[:2]: [] for name in newest}
        for doc, part, array, _, _, _, gone, payload in held.values():
            if (doc, part) not in items:
                continue
            if array == _ROOT:
                roots[doc, part] = payload, gone
            elif not gone:
                items[doc, part].append({"array": array, "payload": payload})
        if roots:
            yield pd.DataFrame([(*d, *root, items[d]) for d, root in roots.items()], columns=_OUTPUT_NAMES)

    def close(self) -> None:
        pass


def _tagged(df: DataFrame, key: str, array: str, pk: tuple[str, ...]) -> DataFrame:
    """Rows as entries; those with a null in their key are skipped.

    The parts of a key of several columns are a JSON array, so no two keys share a text.
    """
    present = df.dropna(subset=[key, *pk])
    texts = [F.col(c).cast("string") for c in pk]
    body = [c for c in strip_metadata(present).columns if c not in ("topic", "partition", "offset", "key", "timestamp")]
    return present.select(
        F.col(key).cast("string").alias("_key"),
        F.lit(array).alias("array"),
        (texts[0] if len(pk) == 1 else F.to_json(F.array(*texts))).alias("pk"),
        F.col("partition").cast("int").alias("part"),
        F.col("offset").alias("pos"),
        is_deleted(present.columns).alias("gone"),
        F.to_json(F.struct(*body)).alias("payload"),
    )


def fold_stream(
    spec: ProfileSpec,
    logs: Mapping[str, DataFrame],
    schemas: Mapping[str, str | T.StructType],
    *,
    slices: int = 1,
    groups: int = GROUPS,
) -> DataFrame:
    """Streams of decoded rows per table to a stream of changed documents.

    ``slices`` > 1 keeps every document in that many parts by child key, each in a group of its own,
    so a document that receives a large share of the changes is worked on by several tasks.
    ``groups``: document slices are dealt by digest to that many groups, and a batch reads and writes
    all that is held of the groups that it changes.  It stays as it is for a checkpoint.
    """
    folded = _grouped(_changes(spec, logs, slices), DOCUMENT_GROUP, groups).transformWithStateInPandas(
        statefulProcessor=DocumentState(), outputStructType=_OUTPUT, outputMode="Update", timeMode="None"
    )
    return _typed(spec, schemas, folded, slices)


def _changes(spec: ProfileSpec, logs: Mapping[str, DataFrame], slices: int) -> DataFrame:
    if spec.reparent != "keep_both" or spec.direction != "from":
        raise ValueError("state is per (parent, child): use the incremental build for other policies")
    root = _tagged(logs[spec.root], spec.key, _ROOT, (spec.key,))
    root = root.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    parts = [root]
    for c in spec.children:
        child = _tagged(logs[c.table], c.fk, c.array, c.pk)
        parts.append(child.withColumn("_slice", slot([F.col("pk")], F.lit(slices))))
    return reduce(DataFrame.unionByName, parts)


def _grouped(changes: DataFrame, by: tuple[str, ...], groups: int):
    """Changes by a digest of some columns: what is known of a group is read and written as one."""
    rows = changes.withColumnsRenamed({"_key": "doc", "_slice": "slice"}).select(*_ROW)
    return rows.withColumn("group", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")).groupBy("group")


def changed_elements(
    spec: ProfileSpec, logs: Mapping[str, DataFrame], *, slices: int = 1, remember_ms: int = REMEMBER_MS,
    groups: int = GROUPS,
) -> DataFrame:
    """Streams of decoded rows per table to a stream of elements that changed, removals included.

    Keep them in a table by ELEMENT_KEY (``elements_table``), newest row first.  Records that are
    delivered again, or out of order within ``remember_ms`` of a removal, change nothing.

    ``groups``: elements are dealt by digest to that many groups, so those of a hot document are worked
    on by all tasks.  A batch reads and writes the positions of the groups that it changes: more groups
    make small batches cheaper, fewer make large ones cheaper.  It stays as it is for a checkpoint.
    """
    changes = _grouped(_changes(spec, logs, slices), ELEMENT_GROUP, groups)
    return changes.transformWithStateInPandas(
        statefulProcessor=ElementState(remember_ms), outputStructType=_ELEMENT, outputMode="Update",
        timeMode="ProcessingTime",
    )


ELEMENT_KEY = ("_key", "segment", "array", "pk")


def elements_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, schema_of(_ELEMENT), ELEMENT_KEY, by="_key", order=("part", "pos"), buckets=buckets)


def documents_of(
    spec: ProfileSpec, schemas: Mapping[str, str | T.StructType], elements: DataFrame, *, slices: int = 1
) -> DataFrame:
    """Documents from the current rows of their elements; of some documents if only theirs are given."""
    is_root = F.col("array") == _ROOT
    folded = elements.groupBy("_key", "segment").agg(
        F.max(F.when(is_root, F.struct("payload", "gone"))).alias("_root"),
        F.collect_list(F.when(~is_root & ~F.col("gone"), F.struct("array", "payload"))).alias("items"),
    )
    rooted = folded.where(F.col("_root").isNotNull())
    return _typed(spec, schemas, rooted.select("_key", "segment", "items", "_root.gone", F.col("_root.payload").alias("root")), slices)


def _typed(spec: ProfileSpec, schemas, folded: DataFrame, slices: int) -> DataFrame:
    root = F.from_json("root", schema_of(schemas[spec.root]))
    columns = [root.alias("_root"), F.col("gone"), F.col("segment")]
    for c in spec.children:
        parsed = F.transform(
            F.filter("items", lambda i: i["array"] == c.array),
            lambda i: F.from_json(i["payload"], schema_of(schemas[c.table])),
        )
        names = [f.name for f in schema_of(schemas[c.table]).fields]
        # the key leads the struct while sorting, then only the embedded fields are left
        keyed = F.transform(parsed, lambda x: F.struct(*[x[k].alias(f"_{k}") for k in c.pk], x.alias("_x")))
        item = lambda e: F.struct(*[e["_x"][src].alias(dst) for src, dst in c.pairs(names)])
        columns.append(F.transform(F.sort_array(keyed), item).alias(c.array))
    docs = folded.select(*columns)
    arrays = [c.array for c in spec.children]
    if spec.root_delete == "mark":
        status = F.when(F.col("gone"), "DELETED").otherwise(F.col("_root")[spec.status_field])
        docs = docs.withColumn("_root", F.col("_root").withField(spec.status_field, status))
    gone = F.col("gone") if spec.root_delete == "drop" else F.lit(False)
    names = [f.name for f in schema_of(schemas[spec.root]).fields]
    fields = [(n, n) for n in names] if spec.fields is None else [(f, f) if isinstance(f, str) else f for f in spec.fields]
    return docs.select(
        *[F.col("_root")[src].alias(dst) for src, dst in fields],
        *arrays,
        "segment",
        F.lit(slices).alias("segments"),
        gone.alias("_gone"),
    )
