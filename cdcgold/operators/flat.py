"""Flat relational reads of a profile and their regrouping into documents."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.operators.edges import left_join_many
from cdcgold.operators.fold import build_profiles, child_rows, root_rows
from cdcgold.spec import ProfileSpec


def flat_rows(spec: ProfileSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Root columns beside each child row, the children stacked rather than multiplied.

    A join of the root with every child at once yields the product of their counts per
    root; stacking yields the sum and carries the same facts.  Columns: the root's fields,
    ``child`` (array name, null on the row of a root without any child), and one struct
    ``{key, item}`` per child.
    """
    roots = root_rows(spec, tables[spec.root])
    stacked = None
    for c in spec.children:
        rows = child_rows(spec, c, tables[c.table]).select(
            "_key",
            F.lit(c.array).alias("child"),
            F.struct(F.col("_pk").alias("key"), F.col("_item").alias("item")).alias(c.array),
        )
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    return left_join_many(roots, stacked, "_key").select(
        "_root.*", "child", *[c.array for c in spec.children]
    )


def assemble(spec: ProfileSpec, flat: DataFrame, *, plan: str = "join") -> DataFrame:
    """Documents from flat rows; repeated rows of one child key count once."""
    root_cols = [c for c in flat.columns if c not in {"child", *(k.array for k in spec.children)}]
    roots = flat.groupBy(spec.key).agg(F.first(F.struct(*root_cols)).alias("_r"))
    tables = {spec.root: roots.select("_r.*")}
    children = []
    for c in spec.children:
        present = flat.where(F.col(c.array).isNotNull())
        once = present.groupBy(spec.key, f"{c.array}.key").agg(
            F.first(f"{c.array}.item").alias("_item")
        )
        parts = flat.schema[c.array].dataType["key"].dataType.names
        keys = [F.col("key")[p].alias(f"_k{i}") for i, p in enumerate(parts)]
        names = flat.schema[c.array].dataType["item"].dataType.names
        tables[c.array] = once.select(F.col(spec.key).alias("_fk"), *keys, "_item.*")
        children.append(
            type(c)(c.array, tuple(f"_k{i}" for i in range(len(c.pk))), "_fk", c.array, tuple(names))
        )
    regrouped = spec.with_(children=tuple(children), fields=None, direction="from")
    return build_profiles(regrouped, tables, plan=plan)


def child_counts(spec: ProfileSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows of each child per parent, in one shuffle of key columns."""
    tagged = [
        child_rows(spec, c, tables[c.table]).select("_key", F.lit(c.array).alias("child"))
        for c in spec.children
    ]
    stacked = reduce(DataFrame.unionByName, tagged)
    counts = [F.count_if(F.col("child") == c.array).alias(c.array) for c in spec.children]
    return stacked.groupBy("_key").agg(*counts)


def rows_scanned(spec: ProfileSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows a join of the root with all children would return per root, without that join."""
    counts = child_counts(spec, tables)
    roots = tables[spec.root].select(F.col(spec.key).alias("_key"))
    joined = roots.join(counts, "_key", "left")
    factors = [
        F.greatest(F.coalesce(F.col(c.array), F.lit(0)), F.lit(1)).cast("decimal(38,0)")
        for c in spec.children
    ]
    product = reduce(F.try_multiply, factors).try_cast("decimal(38,0)")
    size = reduce(lambda a, b: a + b, [F.log10(f) for f in factors])
    return joined.select(
        F.col("_key").alias(spec.key), product.alias("rows_scanned"), size.alias("rows_scanned_log10")
    )


def baseline_profiles(
    spec: ProfileSpec, tables: Mapping[str, DataFrame], *, plan: str = "join"
) -> DataFrame:
    """The relational reader's document: children deduplicated by ``dedupe``, plus rows scanned."""
    collapsed = dict(tables)
    children = []
    for c in spec.children:
        if c.dedupe is None:
            children.append(c)
            continue
        df = tables[c.table]
        first = df.where(F.col(c.dedupe).isNotNull()).groupBy(c.fk, c.dedupe).agg(
            F.min_by(F.struct(*df.columns), F.struct(*c.pk)).alias("_first")
        )
        name = f"{c.table} first per {c.dedupe}"
        collapsed[name] = first.select("_first.*")
        children.append(type(c)(name, c.pk, c.fk, c.array, c.fields, c.other_fk))
    docs = build_profiles(spec.with_(children=tuple(children)), collapsed, plan=plan)
    return docs.join(rows_scanned(spec, tables), spec.key, "left")
