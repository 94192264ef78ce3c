"""Synthetic party tables and change workloads of any size, the same for the same salt.

Every value is a function of the row number, so tables are generated in parallel and a lost
task produces the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcgold.operators.decode import schema_of
from cdcgold.sources.party import ENUMS, SCHEMAS

# Shares, in percent, of the seeded population.
INACTIVE, HOT, HAS_CONTACT, VERIFIED, HAS_TAX, HAS_LINK = 5, 5, 80, 70, 90, 10
HOT_ADDRESSES = 3
# Fixed value: share of inserts, in percent, in a mixed workload.
INSERT_SHARE = 30

# own values, none of which has to equal another system's
_NAMES, _TOWNS = 64, 12
_EPOCH = "timestamp'2021-06-30 12:00:00'"


def _draw(salt: str, below: int, row: str = "id") -> Column:
    """A number in 0..below-1 that depends on the row and the salt only."""
    return F.pmod(F.xxhash64(F.col(row), F.lit(salt)), F.lit(below))


def _chance(salt: str, percent: int) -> Column:
    return _draw(salt, 100) < percent


def _pick(salt: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(salt, len(values)) + 1).cast("int"))


def _name(prefix: str, number: Column, width: int = 4) -> Column:
    """Prefix and number, padded to ``width`` but never cut."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def _shape(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; those not generated are null."""
    fields = schema_of(SCHEMAS[table]).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def synth_tables(spark: SparkSession, customers: int, salt: str = "s") -> dict[str, DataFrame]:
    """Customers 1..n with skewed addresses, contacts, tax records and outgoing links.

    Links never lead back to their own customer; identifications stay empty.
    """
    base = spark.range(1, customers + 1).withColumn("customer_id", _name("party ", F.col("id")))
    now = F.expr(_EPOCH)
    person = base.select(
        "customer_id",
        _name("ref ", F.col("id"), 6).alias("external_ref"),
        _name("given ", _draw(salt + "fn", _NAMES), 2).alias("first_name"),
        _name("family ", _draw(salt + "ln", _NAMES), 2).alias("last_name"),
        F.date_add(F.lit("1950-03-01").cast("date"), _draw(salt + "dob", 20_000).cast("int")).alias("date_of_birth"),
        F.when(_chance(salt + "g", 50), "M").otherwise("F").alias("gender"),
        F.lit("AUS").alias("nationality"),
        F.lit("en-AU").alias("preferred_locale"),
        F.when(_chance(salt + "st", INACTIVE), "INACTIVE").otherwise("ACTIVE").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    number = F.when(_chance(salt + "hot", HOT), HOT_ADDRESSES).otherwise(1)
    spread = base.withColumn("n", F.explode(F.sequence(F.lit(1), number)))
    town = F.pmod(_draw(salt + "town", _TOWNS, "n") + _draw(salt + "town", _TOWNS), F.lit(_TOWNS))
    address = spread.select(
        F.concat_ws("/", F.lit("place"), "id", "n").alias("address_id"),
        "customer_id",
        F.when(F.col("n") == 1, "RESIDENTIAL").otherwise("MAILING").alias("address_type"),
        F.concat_ws(" ", F.lit("Lot"), _draw(salt + "lot", 900), F.lit("Row"), "n").alias("line1"),
        _name("Town ", town, 2).alias("city"),
        _name("Shire ", F.pmod(town, F.lit(4)), 1).alias("state"),
        _name("P", town * 37, 5).alias("postcode"),
        F.lit("AUS").alias("country"),
        (F.col("n") == 1).alias("is_primary"),
        now.alias("updated_at"),
    )
    kind = _pick(salt + "ct", ENUMS["customer_contact", "contact_type"])
    contact = base.where(_chance(salt + "c", HAS_CONTACT)).withColumn("contact_type", kind).select(
        _name("contact ", F.col("id")).alias("contact_id"),
        "customer_id",
        "contact_type",
        F.when(F.col("contact_type") == "EMAIL", F.concat(F.lit("p."), F.col("id").cast("string"), F.lit("@mail.invalid")))
        .otherwise(_name("+999 ", F.col("id"), 9))
        .alias("contact_value"),
        F.lit(True).alias("is_primary"),
        _chance(salt + "v", VERIFIED).alias("is_verified"),
        now.alias("updated_at"),
    )
    tax = base.where(_chance(salt + "t", HAS_TAX)).select(
        _name("levy ", F.col("id")).alias("tax_record_id"),
        "customer_id",
        F.lit("AUS").alias("tax_country"),
        _name("T", _draw(salt + "tid", 1_000_000_000), 9).alias("tax_id"),
        F.lit("TFN").alias("tin_type"),
        now.alias("updated_at"),
    )
    tables = {"customer": person, "customer_address": address, "customer_contact": contact, "customer_tax": tax}
    if customers > 1:
        # a step of 1..n-1 around the ring of customers ends anywhere but at the start
        other = F.pmod(F.col("id") + _draw(salt + "to", customers - 1), F.lit(customers)) + 1
        tables["relationship"] = base.where(_chance(salt + "r", HAS_LINK)).select(
            _name("tie ", F.col("id")).alias("relationship_id"),
            F.col("customer_id").alias("party_id_from"),
            _name("party ", other).alias("party_id_to"),
            _pick(salt + "rt", ENUMS["relationship", "relationship_type"]).alias("relationship_type"),
            now.cast("date").alias("valid_from"),
            F.lit("ACTIVE").alias("status"),
            now.alias("updated_at"),
        )
    out = {t: _shape(df, t) for t, df in tables.items()}
    for t in SCHEMAS:
        out.setdefault(t, spark.createDataFrame([], SCHEMAS[t]))
    return out


def change_workload(spark: SparkSession, customers: int, changes: int, salt: str = "w") -> DataFrame:
    """Mixed inserts and updates of customers as (op, customer_id, field, expected, seq).

    At least one insert; an update sets one field of a customer of ``synth_tables``.
    """
    inserts = max(1, changes * INSERT_SHARE // 100)
    rows = spark.range(changes)
    fresh = F.col("id") < inserts
    field = F.when(fresh, "first_name").otherwise(_pick(salt + "f", ("first_name", "last_name", "status")))
    statuses = _pick(salt + "s", ENUMS["customer", "status"])
    target = _name("party ", _draw(salt + "c", customers) + 1)
    picked = rows.select(
        F.when(fresh, "INSERT").otherwise("UPDATE").alias("op"),
        F.when(fresh, _name("joined ", F.col("id"))).otherwise(target).alias("customer_id"),
        field.alias("field"),
        F.col("id").alias("seq"),
        statuses.alias("_status"),
    )
    value = F.when(F.col("field") == "status", F.col("_status")).otherwise(_name("changed ", F.col("seq")))
    return picked.select("op", "customer_id", "field", value.alias("expected"), "seq")
