"""The six-table party model: customers, their four child tables and their relationships."""

from __future__ import annotations

from cdcgold.operators.checks import ForeignKey, NotNull, OneOf, Unique
from cdcgold.spec import ChildSpec, ProfileSpec

# Table and column names, in the order the source declares them.
SCHEMAS = {
    "customer": (
        "customer_id string, external_ref string, first_name string, last_name string,"
        " date_of_birth date, gender string, nationality string, preferred_locale string,"
        " status string, created_at timestamp, updated_at timestamp"
    ),
    "customer_address": (
        "address_id string, customer_id string, address_type string, line1 string, line2 string,"
        " city string, state string, postcode string, country string, is_primary boolean,"
        " valid_from date, valid_to date, updated_at timestamp"
    ),
    "customer_contact": (
        "contact_id string, customer_id string, contact_type string, contact_value string,"
        " is_primary boolean, is_verified boolean, updated_at timestamp"
    ),
    "customer_identification": (
        "id_record_id string, customer_id string, id_type string, id_number string,"
        " issuing_authority string, issue_date date, expiry_date date, updated_at timestamp"
    ),
    "customer_tax": (
        "tax_record_id string, customer_id string, tax_country string, tax_id string,"
        " tin_type string, updated_at timestamp"
    ),
    "relationship": (
        "relationship_id string, party_id_from string, party_id_to string,"
        " relationship_type string, valid_from date, valid_to date, status string,"
        " updated_at timestamp"
    ),
}

PRIMARY_KEYS = {
    "customer": "customer_id",
    "customer_address": "address_id",
    "customer_contact": "contact_id",
    "customer_identification": "id_record_id",
    "customer_tax": "tax_record_id",
    "relationship": "relationship_id",
}

# The allowed values of enumerated columns.
ENUMS = {
    ("customer", "status"): ("ACTIVE", "INACTIVE", "DECEASED", "SUSPENDED"),
    ("customer_address", "address_type"): ("RESIDENTIAL", "MAILING", "BUSINESS"),
    ("customer_contact", "contact_type"): ("EMAIL", "MOBILE", "HOME_PHONE", "WORK_PHONE"),
    ("customer_identification", "id_type"): ("PASSPORT", "DRIVERS_LICENCE", "NATIONAL_ID", "TFN"),
    ("relationship", "relationship_type"): (
        "JOINT_HOLDER",
        "POWER_OF_ATTORNEY",
        "GUARANTOR",
        "BENEFICIARY",
        "TRUSTEE",
        "EMPLOYER",
    ),
    ("relationship", "status"): ("ACTIVE", "INACTIVE"),
}

# Columns that may not be null, besides the primary keys.
REQUIRED = {
    "customer": ("first_name", "last_name", "status", "created_at", "updated_at"),
    "customer_address": ("customer_id", "address_type", "is_primary", "updated_at"),
    "customer_contact": (
        "customer_id",
        "contact_type",
        "contact_value",
        "is_primary",
        "is_verified",
        "updated_at",
    ),
    "customer_identification": ("customer_id", "id_type", "id_number", "updated_at"),
    "customer_tax": ("customer_id", "tax_country", "updated_at"),
    "relationship": ("party_id_from", "party_id_to", "relationship_type", "status", "updated_at"),
}

FIRST_END, SECOND_END = "party_id_from", "party_id_to"

# The streaming document embeds every column of a child.
STREAMED = ProfileSpec(
    root="customer",
    key="customer_id",
    children=(
        ChildSpec("customer_address", "address_id", "customer_id", "addresses"),
        ChildSpec("customer_contact", "contact_id", "customer_id", "contacts"),
        ChildSpec("customer_identification", "id_record_id", "customer_id", "identifications"),
        ChildSpec("customer_tax", "tax_record_id", "customer_id", "tax_records"),
        ChildSpec("relationship", "relationship_id", FIRST_END, "relationships", other_fk=SECOND_END),
    ),
)

# What the bulk load embeds of each child; edges count at either end.
BULK = STREAMED.with_(
    direction="both",
    children=(
        ChildSpec(
            "customer_address", "address_id", "customer_id", "addresses",
            ("address_id", "address_type", "line1", "line2", "city", "state", "postcode",
             "country", "is_primary"),
        ),
        ChildSpec(
            "customer_contact", "contact_id", "customer_id", "contacts",
            ("contact_id", "contact_type", "contact_value", "is_primary", "is_verified"),
        ),
        ChildSpec(
            "customer_identification", "id_record_id", "customer_id", "identifications",
            ("id_type", "id_number", "expiry_date"),
        ),
        ChildSpec(
            "customer_tax", "tax_record_id", "customer_id", "tax_records",
            ("tax_country", "tax_id", "tin_type"),
        ),
        ChildSpec(
            "relationship", "relationship_id", FIRST_END, "relationships",
            ("relationship_id", FIRST_END, SECOND_END, "relationship_type", ("status", "rel_status")),
            other_fk=SECOND_END,
        ),
    ),
)

# What patching by single events embeds of each child.
PATCHED = STREAMED.with_(
    root_delete="mark",
    children=(
        BULK.children[0],
        BULK.children[1],
        ChildSpec(
            "customer_identification", "id_record_id", "customer_id", "identifications",
            ("id_record_id", "id_type", "id_number", "issuing_authority", "issue_date", "expiry_date"),
        ),
        ChildSpec(
            "customer_tax", "tax_record_id", "customer_id", "tax_records",
            ("tax_record_id", "tax_country", "tax_id", "tin_type"),
        ),
        ChildSpec(
            "relationship", "relationship_id", FIRST_END, "relationships",
            ("relationship_id", SECOND_END, "relationship_type", "valid_from", "valid_to", "status"),
        ),
    ),
)

# The relational reader's document and the coarser keys it deduplicates by.
BASELINE = STREAMED.with_(
    direction="both",
    fields=("customer_id", "external_ref", "first_name", "last_name", "status", "updated_at"),
    children=(
        ChildSpec(
            "customer_address", "address_id", "customer_id", "addresses",
            ("address_id", "address_type", "line1", "city", "state", "postcode"),
        ),
        ChildSpec(
            "customer_contact", "contact_id", "customer_id", "contacts",
            ("contact_id", "contact_type", "contact_value"),
        ),
        ChildSpec(
            "customer_identification", "id_record_id", "customer_id", "identifications",
            ("id_type", "id_number"), dedupe="id_type",
        ),
        ChildSpec(
            "customer_tax", "tax_record_id", "customer_id", "tax_records",
            ("tax_country", "tax_id"), dedupe="tax_country",
        ),
        ChildSpec(
            "relationship", "relationship_id", FIRST_END, "relationships",
            ("relationship_id", "relationship_type", ("status", "rel_status")),
            other_fk=SECOND_END,
        ),
    ),
)

# Arguments of ``views.summary`` for the slim customer view.
SUMMARY = dict(
    key="customer_id",
    name=("first_name", "last_name"),
    keep=("external_ref", "status"),
    first={
        "primary_contact": (
            "contacts", "contact_id", {"type": "contact_type", "value": "contact_value"},
        ),
        "primary_address": (
            "addresses", "address_id", {"city": "city", "state": "state", "postcode": "postcode"},
        ),
    },
    counts={"relationship_count": "relationships"},
)

RECONCILED_FIELDS = ("first_name", "last_name", "status")


def topics(prefix: str) -> list[str]:
    return [f"{prefix}.{table}" for table in SCHEMAS]


def constraints() -> list:
    """The declared keys, references, required columns and enumerations as rules."""
    rules: list = []
    for table, pk in PRIMARY_KEYS.items():
        rules += [Unique(table, (pk,)), NotNull(table, pk)]
        rules += [NotNull(table, c) for c in REQUIRED[table]]
        if table not in ("customer", "relationship"):
            rules.append(ForeignKey(table, "customer_id", "customer", "customer_id"))
    rules.append(Unique("customer", ("external_ref",)))
    rules += [ForeignKey("relationship", end, "customer", "customer_id") for end in (FIRST_END, SECOND_END)]
    rules += [OneOf(table, column, values) for (table, column), values in ENUMS.items()]
    return rules
