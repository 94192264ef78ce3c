"""Consumer reads of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.functions.arrays import size_or_zero
from cdcgold.operators.edges import left_join_many


def scan_ids(docs: DataFrame, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Projected documents whose key is in a list; repeats in the list change nothing."""
    return docs.join(ids.select(key), key, "left_semi").select(*columns)


def lookup(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One answer per asked key (and segment), ``found`` false where there is no document."""
    hit = docs.withColumn("found", F.lit(True))
    answers = left_join_many(ids.select(key).distinct(), hit, key)
    return answers.fillna(False, subset=["found"])


def first_slices(docs: DataFrame) -> DataFrame:
    """One row per document, that with the root fields to compare; sliced documents repeat them."""
    return docs.where(F.col("segment") == 0) if "segment" in docs.columns else docs


def find_by(docs: DataFrame, field: str, value) -> DataFrame:
    return docs.where(F.col(field) == value)


def reverse_edges(docs: DataFrame, array: str, end: str, value) -> DataFrame:
    """Documents with an edge to ``value``."""
    return docs.where(F.exists(array, lambda r: r[end] == F.lit(value)))


def reverse_index(docs: DataFrame, key: str, array: str, end: str) -> DataFrame:
    """(other end, document key) pairs: the bulk form of asking who points at whom."""
    ends = docs.select(F.col(key), F.explode(array).alias("_e"))
    return ends.select(F.col("_e")[end].alias(end), key).distinct()


def newest(docs: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n most recently updated documents."""
    return first_slices(docs).orderBy(F.col(by).desc(), F.col(tie)).limit(n)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Deterministic sample: the n smallest keys."""
    return df.orderBy(key).limit(n)


def summary(
    docs: DataFrame,
    key: str,
    *,
    name: Sequence[str],
    name_as: str = "display_name",
    keep: Sequence[str] = (),
    first: Mapping[str, tuple[str, str, Mapping[str, str]]] | None = None,
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Slim view of documents.

    first   output name -> (array, its key field, {output field: element field}): the element
            of the smallest key, null when the array is empty
    counts  output name -> array whose elements are counted, all of them

    A document in one row is answered by itself; only sliced documents are grouped.
    """
    first, counts = dict(first or {}), dict(counts or {})
    columns = [F.col(key), *[F.col(c) for c in keep]]
    columns.append(F.concat_ws(" ", *name).alias(name_as) if len(name) > 1 else F.col(name[0]).alias(name_as))
    for out, (array, order, fields) in first.items():
        head = F.get(F.col(array), F.lit(0))
        shaped = F.struct(*[head[src].alias(dst) for dst, src in fields.items()])
        columns.append(
            F.when(head.isNotNull(), F.struct(head[order].alias("_order"), shaped.alias("_value"))).alias(out)
        )
    columns += [size_or_zero(array).cast("bigint").alias(out) for out, array in counts.items()]
    plain = [key, *keep, name_as]

    whole = docs.where(F.col("segments") == 1).select(*columns) if "segments" in docs.columns else docs.select(*columns)
    if "segments" in docs.columns:
        parts = docs.where(F.col("segments") > 1).select(*columns)
        merged = parts.groupBy(key).agg(
            *[F.first(c).alias(c) for c in plain[1:]],
            *[F.min_by(out, F.col(out)["_order"]).alias(out) for out in first],
            *[F.sum(out).alias(out) for out in counts],
        )
        whole = whole.unionByName(merged)
    return whole.select(
        *plain, *[F.col(out)["_value"].alias(out) for out in first], *counts
    )
