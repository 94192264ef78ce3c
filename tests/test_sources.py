import duckdb

from cdcgold.sources import party
from cdcgold.sources.tables import range_predicates
from cdcgold.sources.topics import kafka_options
from cdcgold.spec import ChildSpec, ProfileSpec


def test_kafka_reads_all_topics_from_the_start():
    options = kafka_options("broker:9092", party.topics("src.party"), per_trigger=1000)
    assert options["subscribe"].split(",")[0] == "src.party.customer" and options["subscribe"].count(",") == 5
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "1000"


def test_jdbc_parts_are_disjoint_and_complete():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CASE WHEN i % 7 > 0 THEN 'k''' || i END AS k, i FROM range(100) r(i)")
    for key, bounds in (("k", ["k'2", "k'50", "k'9"]), ("i", [10, 40]), ("i", []), ("k", ["zz"])):
        parts = range_predicates(key, bounds)
        found = [r[0] for p in parts for r in con.execute(f"SELECT i FROM t WHERE {p}").fetchall()]
        assert sorted(found) == list(range(100)) and len(parts) == len(bounds) + 1


def test_policies_are_checked():
    spec = ProfileSpec("r", "id", [ChildSpec("c", "pk", "fk", "items", ("a", ("b", "renamed")))])
    assert spec.child("items").pairs([]) == [("a", "a"), ("b", "renamed")]
    assert spec.with_(root_delete="mark").root_delete == "mark"
    for wrong in ({"reparent": "sometimes"}, {"slices": 0}):
        try:
            spec.with_(**wrong)
        except ValueError:
            continue
        raise AssertionError("an unknown policy was taken")
