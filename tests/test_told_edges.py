"""Edges told by type and ends are checked without carrying their keys, and named the same."""

from collections import Counter

from ledgerlens.functions.identity import short_relationship_key
from ledgerlens.operators.graph import build
from ledgerlens.plans.vocabulary import VOCABULARY


def test_told_keys_give_the_same_report_and_are_not_stored(spark, monkeypatch):
    nodes = spark.createDataFrame([("Supplier/1", "Supplier"), ("Supplier/2", "Supplier"), ("Order/1", "Order"), ("Part/1", "Part"), ("Part/1", "Part")], "key string, class_id string")
    rows = [("DELIVERS", "Supplier/1", "Order/1"), ("DELIVERS", "Supplier/2", "Order/1"), ("DELIVERS", "Supplier/1", "Order/9"), ("DELIVERS", "Supplier/1", "Order/9"), ("DELIVERS", "Order/1", "Supplier/1"), ("SUPPORTS", "Supplier/1", "Part/1"), ("SUPPORTS", "Supplier/1", "Part/1"), ("USES_PORTAL", "Supplier/1", "Part/1")]
    ends = spark.createDataFrame(rows, "type string, src string, dst string")
    edges = ends.select(short_relationship_key(ends["type"], ends["src"], ends["dst"]).alias("key"), "*")
    stored = []
    monkeypatch.setattr(build, "shared_checkpoint", lambda df: stored.append(df.columns) or df.localCheckpoint())
    plain = Counter(map(tuple, build.topology_report(nodes, edges, VOCABULARY).collect()))
    told = Counter(map(tuple, build.topology_report(nodes, ends, VOCABULARY, key_of=short_relationship_key).collect()))
    assert told == plain
    assert plain["missing_endpoint", "DELIVERS|10|Supplier/1Order/9"] == 2 and plain["duplicate_relationship", "SUPPORTS|10|Supplier/1Part/1"] == 1
    assert {code for code, _ in plain} == {"duplicate_node", "duplicate_relationship", "missing_endpoint", "invalid_relationship", "cardinality", "disjoint_relationships"}
    assert "key" in stored[1] and "key" not in stored[3]
