"""Correctness checks as DataFrames of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.functions.cdc import META_COLUMNS
from cdcgold.functions.values import percent
from cdcgold.operators.latest import latest
from cdcgold.operators.views import first_slices

# Verdicts of a reconciliation, and of a verified change.
OK, STALE, MISSING = "OK", "STALE", "MISSING"
PASS, FAIL, NOT_FOUND = "PASS", "FAIL", "NOT_FOUND"


def reconcile(
    source: DataFrame, target: DataFrame, key: str, fields: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Verdict and differing fields per source row; ``limit`` checks the first keys only."""
    if limit is not None:
        source = source.orderBy(key).limit(limit)
    src = source.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields])
    tgt = first_slices(target).select(key, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_t_{f}") for f in fields])
    joined = src.join(tgt, key, "left")
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"_s_{f}").cast("string").alias("source"),
                F.col(f"_t_{f}").cast("string").alias("target"),
                F.col(f"_s_{f}").eqNullSafe(F.col(f"_t_{f}")).alias("_same"),
            )
            for f in fields
        ]
    )
    differing = F.transform(
        F.filter(pairs, lambda p: ~p["_same"]),
        lambda p: F.struct(p["field"].alias("field"), p["source"].alias("source"), p["target"].alias("target")),
    )
    missing = F.col("_hit").isNull()
    diffs = F.when(missing, F.slice(differing, 1, 0)).otherwise(differing)
    verdict = F.when(missing, MISSING).when(F.size("diffs") > 0, STALE).otherwise(OK)
    return joined.select(key, diffs.alias("diffs"), "_hit").select(key, verdict.alias("verdict"), "diffs")


def reconcile_summary(verdicts: DataFrame) -> DataFrame:
    """One row of counts and shares; ``passed`` when nothing is missing or stale."""
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in (OK, STALE, MISSING)],
    )
    total = F.col("total")
    shares = [percent(F.col(v.lower()), total).alias(f"{v.lower()}_pct") for v in (OK, STALE, MISSING)]
    passed = (F.col("stale") + F.col("missing") == 0).alias("passed")
    return counts.select("*", *shares, passed)


def verify_changes(
    log: DataFrame, docs: DataFrame, key: str, fields: Sequence[str], order: str = "seq"
) -> DataFrame:
    """PASS / FAIL per expected (key, field); of repeated entries the last one is expected."""
    expected = latest(log, [key, "field"], [order])
    as_text = F.create_map(
        *[x for f in fields for x in (F.lit(f), F.struct(F.col(f).cast("string").alias("v")))]
    )
    actual = first_slices(docs).select(key, as_text.alias("_values"))
    joined = expected.join(actual, key, "left")
    found = F.try_element_at("_values", F.col("field"))
    value = F.when(found.isNull(), NOT_FOUND).otherwise(found["v"])
    out = joined.withColumn("actual", value)
    verdict = F.when(F.col("actual").eqNullSafe(F.col("expected")), PASS).otherwise(FAIL)
    return out.select(key, "op", "field", "expected", "actual", verdict.alias("verdict"))


def missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side the other lacks, counting repeats, with the side they are from."""
    columns = a.columns
    rows = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    net = rows.groupBy(*columns).agg(F.sum("_n").alias("excess"))
    return net.where(F.col("excess") != 0)


def facts(docs: DataFrame, key: str, arrays: Mapping[str, str], fields: Mapping[str, Sequence[str]] | None = None):
    """Documents as (key, child, child key, field, value) rows; the root is child ''.

    ``arrays``: array field -> key field of its elements.
    """
    skip = {key, "segment", "segments", *arrays}
    chosen = fields or {}
    own = _pairs("", F.lit(""), {f: F.col(f) for f in chosen.get("", [c for c in docs.columns if c not in skip])})
    if "segment" in docs.columns:
        own = F.when(F.col("segment") == 0, own).otherwise(F.slice(own, 1, 0))
    parts = [own]
    for array, pk in arrays.items():
        names = docs.schema[array].dataType.elementType.names
        wanted = chosen.get(array, [n for n in names if n != pk])
        parts.append(F.flatten(F.transform(array, _facts_of(array, pk, wanted))))
    # all facts of a row come from one pass over it, whatever the documents cost to build
    return docs.select(F.col(key).cast("string").alias("key"), F.inline(F.concat(*parts)))


def _pairs(child: str, child_key: Column, values: Mapping[str, Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(child).alias("child"),
                child_key.alias("child_key"),
                F.lit(f).alias("field"),
                v.cast("string").alias("value"),
            )
            for f, v in values.items()
        ]
    )


def _facts_of(array: str, pk: str, names: Sequence[str]):
    return lambda e: _pairs(array, e[pk].cast("string"), {n: e[n] for n in names})


_FACT = ["key", "child", "child_key", "field"]


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(*_FACT, F.struct("value").alias("left"))
    right = b.select(*_FACT, F.struct("value").alias("right"))
    return left.join(right, _FACT, "full_outer")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts (see ``facts``) on which two builds disagree, or which one of them lacks."""
    return _paired(a, b).where(~F.col("left").eqNullSafe(F.col("right")))


def parity_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per child table, the facts of the first build and how many differ between the two."""
    return _paired(a, b).groupBy("child").agg(
        F.count("left").alias("n_facts"),
        F.count_if(~F.col("left").eqNullSafe(F.col("right"))).alias("n_differences"),
    )


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class OneOf:
    table: str
    column: str
    values: tuple[str, ...]


def violations(tables: Mapping[str, DataFrame], rules: Sequence) -> DataFrame:
    """One row per rule and offending value with the number of rows that carry it.

    All not-null and one-of rules of a table take one scan, whose bad values are counted before
    they leave their task; unique and foreign keys take a shuffle of counted key values each.
    """
    by_row: dict[str, list] = {}
    for r in rules:
        if isinstance(r, (NotNull, OneOf)):
            by_row.setdefault(r.table, []).append(r)
    found = [_row_violations(tables[t], t, own) for t, own in by_row.items()]
    found += [_key_violations(tables, r) for r in rules if isinstance(r, (Unique, ForeignKey))]
    return reduce(DataFrame.unionByName, found)


def _row_violations(df: DataFrame, table: str, rules: Sequence[NotNull | OneOf]) -> DataFrame:
    bad = []
    for r in rules:
        value = F.col(r.column)
        kind, wrong = ("not_null", value.isNull()) if isinstance(r, NotNull) else ("one_of", ~value.isin(*r.values))
        text = F.coalesce(value.cast("string"), F.lit("null"))
        bad.append(F.when(wrong, F.struct(F.lit(kind).alias("rule"), F.lit(r.column).alias("column"), text.alias("value"))))
    hit = df.select(F.explode(F.array_compact(F.array(*bad))).alias("v")).select("v.*")
    counted = hit.groupBy("rule", "column", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit(table).alias("table"), "rule", "column", "value", "n_rows")


def _key_violations(tables: Mapping[str, DataFrame], rule: Unique | ForeignKey) -> DataFrame:
    df, n = tables[rule.table], F.count(F.lit(1)).alias("n_rows")
    if isinstance(rule, Unique):
        columns, kind = rule.columns, "unique"
        bad = df.dropna(subset=list(columns)).groupBy(*columns).agg(n).where(F.col("n_rows") > 1)
    else:
        columns, kind = (rule.column,), "foreign_key"
        parents = tables[rule.parent].select(F.col(rule.parent_column).alias(rule.column))
        counts = df.dropna(subset=[rule.column]).groupBy(rule.column).agg(n)
        bad = counts.join(parents, rule.column, "left_anti")
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return bad.select(
        F.lit(rule.table).alias("table"),
        F.lit(kind).alias("rule"),
        F.lit(",".join(columns)).alias("column"),
        value.alias("value"),
        "n_rows",
    )


def metadata_paths(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of metadata fields in a schema, also inside structs, arrays and maps."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            here = f"{path}.{f.name}" if path else f.name
            found += [here] if f.name in META_COLUMNS else []
            found += metadata_paths(f.dataType, here)
    elif isinstance(schema, T.ArrayType):
        found += metadata_paths(schema.elementType, f"{path}[]")
    elif isinstance(schema, T.MapType):
        found += metadata_paths(schema.valueType, f"{path}{{}}")
    return found


def layer_hygiene(bronze: DataFrame, gold_values: DataFrame, value: str = "value") -> DataFrame:
    """Per metadata field: bronze rows that lack it, and published documents that leak it.

    Both columns are 0 in a clean pipeline.
    """
    per_field = []
    for name in META_COLUMNS:
        lacking = F.count_if(F.col(name).isNull()) if name in bronze.columns else F.count(F.lit(1))
        per_field.append(F.struct(F.lit(name).alias("field"), lacking.alias("bronze_lacking")))
    lacks = bronze.agg(F.array(*per_field).alias("f")).select(F.inline("f"))
    leaking = [
        F.struct(
            F.lit(name).alias("field"),
            F.count_if(F.col(value).contains(f'"{name}":')).alias("gold_leaking"),
        )
        for name in META_COLUMNS
    ]
    leaks = gold_values.agg(F.array(*leaking).alias("f")).select(F.inline("f"))
    return lacks.join(leaks, "field")
