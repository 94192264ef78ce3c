"""Why records were rejected: the table, the field and what it holds, one row per finding.

Values are read as VARIANT, which keeps whatever JSON is there, so a wrong field can be named
where a parse against the table's schema only says that it failed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.functions.cdc import table_of
from cdcgold.operators.decode import schema_of

# The reasons.
UNKNOWN_TABLE, EMPTY, NOT_JSON = "unknown table", "empty value", "not json"
NOT_AN_OBJECT, WRONG_TYPE, MISSING_KEY = "not an object", "wrong type", "missing key"

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE")


def _fits(kind: Column, wanted: T.DataType) -> Column:
    """Does a JSON value of this kind read as the type?  Text reads as dates, and anything as text."""
    if isinstance(wanted, T.StringType):
        return F.lit(True)
    if isinstance(wanted, T.BooleanType):
        return kind == "BOOLEAN"
    if isinstance(wanted, T.IntegralType):
        return kind == "BIGINT"
    if isinstance(wanted, T.NumericType):
        return kind.isin(*_NUMBERS)
    if isinstance(wanted, (T.StructType, T.MapType)):
        return kind == "OBJECT"
    if isinstance(wanted, T.ArrayType):
        return kind == "ARRAY"
    return kind.isin("BIGINT", "STRING")


def _kind(value: Column) -> Column:
    """BIGINT, STRING, OBJECT, ...; VOID for a JSON null, null for nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _finding(reason: str, field: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(reason).alias("reason"),
        (none if field is None else field).alias("field"),
        (none if detail is None else detail).alias("detail"),
    )


def _of_fields(schema: T.StructType, keys: Sequence[str]) -> Column:
    """The findings on the fields of the row in ``_row``."""
    out = []
    for f in schema.fields:
        value = F.try_variant_get("_row", f"$.{f.name}", "variant")
        kind = F.coalesce(_kind(value), F.lit("VOID"))
        wrong = _finding(WRONG_TYPE, F.lit(f.name), F.concat(F.lit(f"{f.dataType.simpleString()} expected, "), F.lower(kind)))
        out.append(F.when((kind != "VOID") & ~_fits(kind, f.dataType), wrong))
        if f.name in keys:
            out.append(F.when(kind == "VOID", _finding(MISSING_KEY, F.lit(f.name))))
    return F.array_compact(F.array(*out))


def diagnose(
    records: DataFrame, schemas: Mapping[str, str | T.StructType], keys: Mapping[str, Sequence[str]]
) -> DataFrame:
    """(topic, partition, offset, table, reason, field, detail) per finding; sound records have none.

    ``schemas``: table -> its row as it is on the wire; ``keys``: the fields a row cannot lack.
    A value may be the row or wrap it as ``{schema, payload}``; a null value is no finding.
    """
    table = F.coalesce(table_of("topic"), F.lit(""))
    parsed = F.try_parse_json("value")
    held = records.where(F.col("value").isNotNull()).select(
        "topic", "partition", "offset", "value", table.alias("table"), F.explode(F.array(parsed)).alias("_v")
    )
    payload = F.try_variant_get("_v", "$.payload", "variant")
    rows = held.withColumn("_row", F.when(_kind(payload) == "OBJECT", payload).otherwise(F.col("_v")))
    whole = F.when(~F.col("table").isin(*schemas), F.array(_finding(UNKNOWN_TABLE, detail=F.col("topic"))))
    whole = whole.when(F.trim("value") == "", F.array(_finding(EMPTY)))
    whole = whole.when(F.col("_v").isNull(), F.array(_finding(NOT_JSON)))
    whole = whole.when(_kind(F.col("_row")) != "OBJECT", F.array(_finding(NOT_AN_OBJECT, detail=F.lower(_kind(F.col("_row"))))))
    for name, schema in schemas.items():
        whole = whole.when(F.col("table") == name, _of_fields(schema_of(schema), keys.get(name, ())))
    found = rows.select("topic", "partition", "offset", "table", F.explode(whole).alias("_f"))
    return found.select("topic", "partition", "offset", "table", "_f.*")
