"""The four ways of building a party document, and the policies on which they differ."""

import pytest
from party_data import ROWS, Log, address, contact, customer, documents, frames, link
from pyspark.sql import functions as F

from cdcgold.functions.cdc import META_COLUMNS, table_of
from cdcgold.operators import checks, flat, views
from cdcgold.operators.decode import decode, publish
from cdcgold.operators.flat import assemble, baseline_profiles, child_counts, flat_rows, rows_scanned
from cdcgold.operators.fold import build_profiles, profiles_from_logs
from cdcgold.sources import party
from cdcgold.sources.wire import from_wire, to_wire, wire_schema


def decoded(spark, log):
    raw = log.frame(spark)
    out = {}
    for table, ddl in party.SCHEMAS.items():
        good, _ = decode(raw.where(table_of("topic") == table), wire_schema(ddl))
        out[table] = from_wire(good, ddl)
    return out


def fold(spark, log, **policy):
    return documents(profiles_from_logs(party.STREAMED.with_(**policy), decoded(spark, log)))


def ids(doc, array, key):
    return [x[key] for x in doc[array]]


def test_streamed_document_has_every_column_and_no_metadata(spark):
    docs = fold(spark, Log().snapshot())
    assert set(docs) == {"p1", "p2", "p3", "p4", "p5"}
    one = docs["p1"]
    assert ids(one, "addresses", "address_id") == ["a1", "a2"]
    assert one["addresses"][0] == ROWS["customer_address"][1]
    assert one["date_of_birth"] == ROWS["customer"][0]["date_of_birth"]
    assert one["created_at"] == ROWS["customer"][0]["created_at"]
    assert ids(one, "relationships", "relationship_id") == ["r1"]
    assert docs["p5"]["addresses"] == docs["p5"]["tax_records"] == []
    df = profiles_from_logs(party.STREAMED, decoded(spark, Log().snapshot()))
    assert checks.metadata_paths(df.schema) == []
    assert not set(META_COLUMNS) & set(df.columns)


@pytest.mark.parametrize("plan", ["join", "union"])
def test_plans_agree_on_tables_and_log(spark, plan):
    tables = frames(spark)
    expected = documents(build_profiles(party.STREAMED, tables))
    assert documents(build_profiles(party.STREAMED, tables, plan=plan)) == expected
    assert fold(spark, Log().snapshot()) == expected


def test_root_delete_policies(spark):
    log = Log().snapshot().add("customer", customer(1, first_name="Last image"), "d").raw("customer", None, "p1")
    kept = fold(spark, log)["p1"]
    assert (kept["first_name"], kept["status"], len(kept["addresses"])) == ("Last image", "ACTIVE", 2)
    assert fold(spark, log, root_delete="mark")["p1"]["status"] == "DELETED"
    assert "p1" not in fold(spark, log, root_delete="drop")
    again = log.add("customer", customer(1), "c")
    assert fold(spark, again, root_delete="drop")["p1"]["status"] == "ACTIVE"


def test_child_delete_and_tombstone(spark):
    log = Log().snapshot().add("customer_address", address(1, "p1"), "d").raw("customer_address", None, "a1")
    assert ids(fold(spark, log)["p1"], "addresses", "address_id") == ["a2"]


def test_child_moves_to_another_parent(spark):
    log = Log().snapshot().add("customer_address", address(1, "p5"))
    both = fold(spark, log)
    assert ids(both["p1"], "addresses", "address_id") == ["a1", "a2"]
    assert ids(both["p5"], "addresses", "address_id") == ["a1"]
    moved = fold(spark, log, reparent="move")
    assert ids(moved["p1"], "addresses", "address_id") == ["a2"]
    assert ids(moved["p5"], "addresses", "address_id") == ["a1"]


def test_child_waits_for_its_root(spark):
    log = Log().add("customer_contact", contact(9, "p9"), "c")
    assert fold(spark, log) == {}
    assert ids(fold(spark, log.add("customer", customer(9), "c"))["p9"], "contacts", "contact_id") == ["c9"]


def test_direction_of_edges_and_self_loop(spark):
    docs = fold(spark, Log().snapshot(), direction="both")
    assert ids(docs["p1"], "relationships", "relationship_id") == ["r1", "r2"]
    assert ids(docs["p2"], "relationships", "relationship_id") == ["r1"]
    assert ids(docs["p4"], "relationships", "relationship_id") == ["r3"]


def test_last_arrival_wins_whatever_the_source_clock_says(spark):
    log = Log()
    for status in ("ACTIVE", "INACTIVE", "SUSPENDED", "ACTIVE", "INACTIVE"):
        log.add("customer", customer(3, status=status))
    docs = fold(spark, log)
    assert len(docs) == 1 and docs["p3"]["status"] == "INACTIVE"


def test_wrapped_payload_numeric_key_and_poison(spark):
    log = Log().add("customer", customer(1), wrapped=True).raw("customer", '{"customer_id": "p2"')
    log.raw("customer", "").raw("customer", None).raw("customer", '{"customer_id": 77, "first_name": "N"}')
    log.raw("customer", '{"customer_id": "p3", "updated_at": "not a number"}')
    good, bad = decode(log.frame(spark), wire_schema(party.SCHEMAS["customer"]))
    assert {r.customer_id for r in good.collect()} == {"p1", "77"}
    rejected = {(r.offset, r.reason) for r in bad.collect()}
    assert rejected == {(1, "unparseable value"), (2, "empty value"), (5, "unparseable value")}


def test_wire_round_trip(spark):
    for table, df in frames(spark).items():
        there = to_wire(df, party.SCHEMAS[table])
        back = from_wire(there, party.SCHEMAS[table])
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_bulk_document_fields(spark):
    docs = documents(build_profiles(party.BULK, frames(spark)))
    one = docs["p1"]
    assert set(one["identifications"][0]) == {"id_type", "id_number", "expiry_date"}
    assert len(one["identifications"]) == 3
    assert set(one["tax_records"][0]) == {"tax_country", "tax_id", "tin_type"}
    assert one["relationships"][0]["rel_status"] == "ACTIVE"
    assert ids(one, "relationships", "relationship_id") == ["r1", "r2"]
    assert one["contacts"][1]["is_verified"] is True


def test_assemble_equals_fold_even_with_repeated_flat_rows(spark):
    tables = frames(spark)
    flat = flat_rows(party.BULK, tables)
    expected = documents(build_profiles(party.BULK, tables))
    assert documents(assemble(party.BULK, flat)) == expected
    assert documents(assemble(party.BULK, flat.unionByName(flat))) == expected


def test_flat_rows_are_the_sum_of_children(spark):
    flat = flat_rows(party.BULK, frames(spark))
    per_root = {r.customer_id: r["count"] for r in flat.groupBy("customer_id").count().collect()}
    assert per_root == {"p1": 2 + 2 + 3 + 3 + 2, "p2": 1 + 1 + 1, "p3": 1 + 1, "p4": 1 + 1, "p5": 1}


def test_rows_scanned_is_the_product(spark):
    tables = frames(spark)
    got = {r.customer_id: int(r.rows_scanned) for r in rows_scanned(party.BASELINE, tables).collect()}
    assert got == {"p1": 2 * 2 * 3 * 3 * 2, "p2": 1, "p3": 1, "p4": 1, "p5": 1}
    counts = {r["_key"]: r.identifications for r in child_counts(party.BASELINE, tables).collect()}
    assert counts["p1"] == 3


def test_baseline_keeps_one_per_type_and_country(spark):
    one = documents(baseline_profiles(party.BASELINE, frames(spark)))["p1"]
    assert one["identifications"] == [
        {"id_type": "PASSPORT", "id_number": "N1"}, {"id_type": "TFN", "id_number": "N3"},
    ]
    assert one["tax_records"] == [{"tax_country": "AUS", "tax_id": "91"}, {"tax_country": "NZL", "tax_id": "92"}]
    assert one["rows_scanned"] == 72
    assert "date_of_birth" not in one


def test_summary(spark):
    slim = documents(views.summary(build_profiles(party.BULK, frames(spark)), **party.SUMMARY))
    assert slim["p1"] == {
        "customer_id": "p1", "external_ref": "x1", "status": "ACTIVE", "display_name": "First1 Last1",
        "primary_contact": {"type": "EMAIL", "value": "m1@example.org"},
        "primary_address": {"city": "Town", "state": "NSW", "postcode": "2001"},
        "relationship_count": 2,
    }
    assert slim["p5"]["primary_contact"] is None and slim["p5"]["primary_address"] is None
    assert slim["p5"]["relationship_count"] == 0


@pytest.mark.parametrize("plan", ["join", "union"])
def test_declared_slices_hold_all_children(spark, plan):
    rows = {**ROWS, "customer_address": [address(i, "p1") for i in range(90)] + [address(95, "p2")]}
    tables = frames(spark, rows)
    whole_docs = build_profiles(party.BULK, tables)
    n = whole_docs.count()
    docs = build_profiles(party.BULK.with_(slices=5), tables, plan=plan)
    assert docs.count() == 5 * n and docs.select("customer_id").distinct().count() == n
    parts = docs.where(F.col("customer_id") == "p1").collect()
    assert {p.segments for p in parts} == {5} and sorted(p.segment for p in parts) == [0, 1, 2, 3, 4]
    found = sorted(a.address_id for p in parts for a in p.addresses)
    assert found == sorted(f"a{i}" for i in range(90))
    assert max(len(p.addresses) for p in parts) < 40
    assert documents(views.summary(docs, **party.SUMMARY)) == documents(views.summary(whole_docs, **party.SUMMARY))
    facts = checks.facts(docs, "customer_id", {"addresses": "address_id"})
    whole_facts = checks.facts(whole_docs, "customer_id", {"addresses": "address_id"})
    # root arrays other than addresses are compared per document above
    keep = F.col("child") == "addresses"
    assert checks.multiset_difference(facts.where(keep), whole_facts.where(keep)).count() == 0


def test_one_message_and_verdict_per_declared_key(spark):
    tables = frames(spark, ROWS)
    whole, sliced = (build_profiles(party.BULK.with_(slices=k), tables) for k in (1, 3))
    n = whole.count()
    for docs, key in ((whole, ["customer_id"]), (sliced, ["customer_id", "segment"])):
        sent = publish(docs, *key)
        assert sent.count() == sent.select("key").distinct().count() == docs.count()
        verdicts = checks.reconcile(tables["customer"], docs, "customer_id", ["status"])
        assert verdicts.count() == tables["customer"].count()
        assert views.newest(docs, "customer_id", 2, "customer_id").select("customer_id").distinct().count() == min(2, n)
    with pytest.raises(ValueError):
        publish(sliced, "customer_id")


def test_rows_scanned_of_a_very_hot_root_is_null_with_its_size(spark, monkeypatch):
    tables = frames(spark)
    counts = tables["customer"].select(F.col("customer_id").alias("_key"))
    for c in party.BASELINE.children:
        counts = counts.withColumn(c.array, F.lit(10**8).cast("long"))
    monkeypatch.setattr(flat, "child_counts", lambda *_: counts)
    row = flat.rows_scanned(party.BASELINE, tables).first()
    assert row.rows_scanned is None and row.rows_scanned_log10 == 8 * len(party.BASELINE.children)


def test_links_of_a_party_to_itself_and_null_end(spark):
    rows = {**ROWS, "relationship": [link(1, "p1", "p1"), link(2, "p1", None), link(3, None, "p2")]}
    docs = documents(build_profiles(party.BULK, frames(spark, rows)))
    assert ids(docs["p1"], "relationships", "relationship_id") == ["r1", "r2"]
    assert ids(docs["p2"], "relationships", "relationship_id") == ["r3"]
