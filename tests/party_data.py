"""A small invented party data set: rows of the six tables and change records over them."""

from __future__ import annotations

import json
from datetime import date, datetime

from cdcgold.operators.decode import schema_of
from cdcgold.sources.party import PRIMARY_KEYS, SCHEMAS
from cdcgold.sources.topics import RECORD_SCHEMA

T0 = datetime(2024, 5, 1, 12, 0, 0)


def customer(n, **kw):
    row = dict(
        customer_id=f"p{n}", external_ref=f"x{n}", first_name=f"First{n}", last_name=f"Last{n}",
        date_of_birth=date(1980, 1, n), gender="F", nationality="AUS", preferred_locale="en-AU",
        status="ACTIVE", created_at=T0, updated_at=T0,
    )
    return {**row, **kw}


def address(n, of, **kw):
    row = dict(
        address_id=f"a{n}", customer_id=of, address_type="MAILING", line1=f"{n} Road", line2=None,
        city="Town", state="NSW", postcode=f"20{n:02d}", country="AUS", is_primary=False,
        valid_from=date(2020, 1, 1), valid_to=None, updated_at=T0,
    )
    return {**row, **kw}


def contact(n, of, **kw):
    row = dict(
        contact_id=f"c{n}", customer_id=of, contact_type="EMAIL", contact_value=f"m{n}@example.org",
        is_primary=True, is_verified=n % 2 == 0, updated_at=T0,
    )
    return {**row, **kw}


def identification(n, of, **kw):
    row = dict(
        id_record_id=f"i{n}", customer_id=of, id_type="PASSPORT", id_number=f"N{n}",
        issuing_authority="Office", issue_date=date(2019, 3, 1), expiry_date=date(2029, 3, 1), updated_at=T0,
    )
    return {**row, **kw}


def tax(n, of, **kw):
    row = dict(tax_record_id=f"t{n}", customer_id=of, tax_country="AUS", tax_id=f"9{n}", tin_type="TFN", updated_at=T0)
    return {**row, **kw}


def link(n, a, b, **kw):
    row = dict(
        relationship_id=f"r{n}", party_id_from=a, party_id_to=b, relationship_type="TRUSTEE",
        valid_from=date(2021, 1, 1), valid_to=None, status="ACTIVE", updated_at=T0,
    )
    return {**row, **kw}


ROWS = {
    "customer": [customer(i) for i in range(1, 6)],
    "customer_address": [address(2, "p1"), address(1, "p1", is_primary=True), address(3, "p2")],
    "customer_contact": [contact(1, "p1"), contact(2, "p1", contact_type="MOBILE"), contact(3, "p3")],
    "customer_identification": [
        identification(1, "p1"), identification(2, "p1", id_number="SECOND"),
        identification(3, "p1", id_type="TFN"), identification(4, "p4"),
    ],
    "customer_tax": [tax(1, "p1"), tax(2, "p1", tax_country="NZL"), tax(3, "p1"), tax(4, "p2")],
    "relationship": [link(1, "p1", "p2"), link(2, "p3", "p1"), link(3, "p4", "p4")],
}


def frames(spark, rows=ROWS):
    out = {}
    for table, ddl in SCHEMAS.items():
        names = schema_of(ddl).names
        out[table] = spark.createDataFrame([tuple(r[c] for c in names) for r in rows[table]], ddl)
    return out


def wire(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime):
        return int(value.timestamp() * 1000)
    if isinstance(value, date):
        return (value - date(1970, 1, 1)).days
    return value


class Log:
    """Records of several topics in arrival order."""

    def __init__(self):
        self.records = []
        self.offsets = {}

    def add(self, table, row, op="u", wrapped=False):
        value = {k: wire(v) for k, v in row.items()}
        value |= {"__op": op, "__table": table, "__source_ts_ms": 1000 * len(self.records),
                  "__deleted": "true" if op == "d" else "false"}
        if wrapped:
            value = {"schema": None, "payload": value}
        return self.raw(table, json.dumps(value), str(row[PRIMARY_KEYS[table]]))

    def raw(self, table, value, key=None):
        offset = self.offsets.get(table, 0)
        self.offsets[table] = offset + 1
        self.records.append((f"src.party.{table}", 0, offset, key, value, T0))
        return self

    def snapshot(self, rows=ROWS):
        for table in rows:
            for row in rows[table]:
                self.add(table, row, "r")
        return self

    def frame(self, spark, records=None):
        return spark.createDataFrame(self.records if records is None else records, RECORD_SCHEMA)


def plain(value):
    """Rows as nested plain values."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def documents(df, key="customer_id"):
    return {r[key]: plain(r) for r in df.collect()}
