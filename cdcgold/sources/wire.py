"""Between a table's declared types and the types its change events carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcgold.functions.values import epoch_date, epoch_timestamp, flag
from cdcgold.operators.decode import schema_of


def wire_schema(table: str | T.StructType) -> T.StructType:
    """Dates travel as epoch days, timestamps as epoch milliseconds, flags as 0/1."""
    wire = {T.DateType: T.IntegerType(), T.TimestampType: T.LongType(), T.BooleanType: T.StringType()}
    fields = schema_of(table).fields
    return T.StructType([T.StructField(f.name, wire.get(type(f.dataType), f.dataType)) for f in fields])


def from_wire(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Decoded event columns to the declared types; other columns pass through."""
    convert = {T.DateType: epoch_date, T.TimestampType: epoch_timestamp, T.BooleanType: flag}
    typed = {f.name: convert[type(f.dataType)] for f in schema_of(table).fields if type(f.dataType) in convert}
    return df.select(*[typed[c](c).alias(c) if c in typed else F.col(c) for c in df.columns])


def to_wire(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Declared types to event columns, for logs made from tables."""
    convert = {
        T.DateType: lambda c: F.unix_date(c),
        T.TimestampType: lambda c: F.unix_millis(F.col(c)),
        T.BooleanType: lambda c: F.col(c).cast("int"),
    }
    typed = {f.name: convert[type(f.dataType)] for f in schema_of(table).fields if type(f.dataType) in convert}
    return df.select(*[typed[c](c).alias(c) if c in typed else F.col(c) for c in df.columns])
