"""Folding child tables into arrays of their parents' documents.

Every plan aggregates the children before they meet the root, so no product of children
ever exists.  A spec may declare ``slices``: a document is then always that many rows, and a
digest of the child key deals its children to them, so no task has to hold all of a hot parent.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcgold.functions.cdc import META_COLUMNS
from cdcgold.functions.values import slot
from cdcgold.operators.edges import either_end
from cdcgold.operators.latest import LOG_ORDER, current_child, current_root
from cdcgold.spec import ChildSpec, ProfileSpec


def _visible(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in META_COLUMNS and c != "_key"]


def child_rows(spec: ProfileSpec, child: ChildSpec, df: DataFrame) -> DataFrame:
    """(parent key, child key, embedded struct) per child row and parent."""
    if spec.direction == "both" and child.other_fk:
        df = either_end(df, child.fk, child.other_fk, "_key")
    else:
        df = df.where(F.col(child.fk).isNotNull()).withColumn("_key", F.col(child.fk))
    pairs = child.pairs(_visible(df.columns))
    item = F.struct(*[F.col(c).alias(n) for c, n in pairs])
    embedded = dict(pairs)
    pk = F.struct(*[F.col(c).alias(embedded.get(c, f"_{c}")) for c in child.pk])
    return df.select("_key", pk.alias("_pk"), item.alias("_item"))


def root_rows(spec: ProfileSpec, df: DataFrame) -> DataFrame:
    """(key, struct of the root's document fields)."""
    pairs = (
        [(c, c) for c in _visible(df.columns)]
        if spec.fields is None
        else [(f, f) if isinstance(f, str) else tuple(f) for f in spec.fields]
    )
    fields = F.struct(*[F.col(c).alias(n) for c, n in pairs])
    return df.where(F.col(spec.key).isNotNull()).select(
        F.col(spec.key).alias("_key"), fields.alias("_root")
    )


def _slice_children(rows: DataFrame, slices: int) -> DataFrame:
    if slices == 1:
        return rows
    pk = [F.col("_pk")[f.name] for f in rows.schema["_pk"].dataType.fields]
    return rows.withColumn("segment", slot(pk, F.lit(slices)))


def _slice_roots(rows: DataFrame, slices: int) -> DataFrame:
    if slices == 1:
        return rows
    return rows.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def _element(rows: DataFrame) -> Column:
    """What to collect of a child row so that sorting the collected array orders it by key.

    An item that begins with its key fields sorts by itself; otherwise the key goes along.
    """
    pk, item = rows.schema["_pk"].dataType.names, rows.schema["_item"].dataType.names
    return F.col("_item") if item[: len(pk)] == pk else F.struct("_pk", "_item")


def _array(collected: Column, keyed: bool) -> Column:
    ordered = F.sort_array(collected)
    return F.transform(ordered, lambda e: e["_item"]) if keyed else ordered


def _is_keyed(element) -> bool:
    return element.names == ["_pk", "_item"]


def fold_children(rows: DataFrame, array: str, by: list[str]) -> DataFrame:
    """One array per parent.

    Collecting shrinks nothing, so rows are shuffled as they are and gathered behind the
    shuffle only; gathering in front of it too would sort every task's input for no gain.
    """
    gathered = rows.select(*by, _element(rows).alias("_e")).repartition(*by)
    keyed = _is_keyed(gathered.schema["_e"].dataType)
    return gathered.groupBy(*by).agg(_array(F.collect_list("_e"), keyed).alias(array))


def attach(parents: DataFrame, folded: DataFrame, array: str, by: list[str]) -> DataFrame:
    """Left join one folded child; a parent without children gets an empty array."""
    empty = F.array().cast(folded.schema[array].dataType)
    joined = parents.join(folded, by, "left")
    return joined.withColumn(array, F.coalesce(F.col(array), empty))


def build_profiles(spec: ProfileSpec, tables: Mapping[str, DataFrame], *, plan: str = "join") -> DataFrame:
    """Documents from the current rows of every table, each table read once.

    plan ``join``: each child is folded by itself and left-joined, all on one key.
    plan ``union``: root and children are stacked and meet in a single shuffle.
    Output: the root's fields, one array per child, ``segment`` and ``segments`` (the spec's slices).
    """
    roots = _slice_roots(root_rows(spec, tables[spec.root]), spec.slices)
    children = {
        c.array: _slice_children(child_rows(spec, c, tables[c.table]), spec.slices) for c in spec.children
    }
    by = ["_key"] if spec.slices == 1 else ["_key", "segment"]
    build = {"join": _by_joins, "union": _by_union}[plan]
    docs = build(roots, children, by)
    segment = F.lit(0) if spec.slices == 1 else F.col("segment")
    return docs.select("_root.*", *children, segment.alias("segment"), F.lit(spec.slices).alias("segments", metadata={"slices": spec.slices}))


def _by_joins(roots: DataFrame, children: dict[str, DataFrame], by: list[str]) -> DataFrame:
    docs = roots
    for array, rows in children.items():
        docs = attach(docs, fold_children(rows, array, by), array, by)
    return docs


def _by_union(roots: DataFrame, children: dict[str, DataFrame], by: list[str]) -> DataFrame:
    stacked = roots.select(*by, F.struct("_root").alias("_parent"))
    for array, rows in children.items():
        tagged = rows.select(*by, _element(rows).alias(f"_c_{array}"))
        stacked = stacked.unionByName(tagged, allowMissingColumns=True)
    folds = [
        _array(F.collect_list(f"_c_{a}"), _is_keyed(stacked.schema[f"_c_{a}"].dataType)).alias(a)
        for a in children
    ]
    parent = F.first("_parent", ignorenulls=True).alias("_parent")
    grouped = stacked.repartition(*by).groupBy(*by).agg(parent, *folds)
    return grouped.where(F.col("_parent").isNotNull()).select(*by, "_parent.*", *children)


def only_parents(
    spec: ProfileSpec, tables: Mapping[str, DataFrame], ids: DataFrame
) -> dict[str, DataFrame]:
    """The tables cut down to the rows of some parents, before anything is folded.

    ``ids`` has one column.  Repeated ids change nothing.
    """
    out = {spec.root: tables[spec.root].join(ids.toDF(spec.key), spec.key, "left_semi")}
    for c in spec.children:
        rows = tables[c.table]
        mine = rows.join(ids.toDF(c.fk), c.fk, "left_semi").select(*rows.columns)
        if spec.direction == "both" and c.other_fk:
            others = rows.join(ids.toDF(c.fk), c.fk, "left_anti")
            far = others.join(ids.toDF(c.other_fk), c.other_fk, "left_semi").select(*rows.columns)
            mine = mine.unionByName(far)
        out[c.table] = mine
    return out


def tables_from_logs(spec: ProfileSpec, logs: Mapping[str, DataFrame], order=LOG_ORDER):
    """Current rows of every table from its decoded change log."""
    tables = {c.table: current_child(spec, c, logs[c.table], order) for c in spec.children}
    tables[spec.root] = current_root(spec, logs[spec.root], order)
    return tables


def profiles_from_logs(
    spec: ProfileSpec, logs: Mapping[str, DataFrame], *, order=LOG_ORDER, plan: str = "join"
) -> DataFrame:
    return build_profiles(spec, tables_from_logs(spec, logs, order), plan=plan)


def items(docs: DataFrame, key: str, array: str) -> DataFrame:
    """One row per array element, with the document key ahead of its fields."""
    exploded = docs.select(F.col(key).alias("_key"), F.explode(array).alias("_item"))
    return exploded.select("_key", "_item.*")
