"""Graph operators on a small portfolio graph with known paths."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.identity import entity_key
from ledgerlens.operators.catalog.ontology import BusinessClass, Ontology, Property, Relation
from ledgerlens.operators.graph import build, evidence, traverse

IN, OUT = traverse.IN, traverse.OUT


def graph(spark, triples):
    edges = spark.createDataFrame([(f"{t}:{a}>{b}", t, a, b) for t, a, b in triples], "key string, type string, src string, dst string")
    return edges


TRIPLES = [
    ("PARTY_TO", "V1", "C1"), ("PARTY_TO", "V2", "C2"), ("HAS_CLAUSE", "C1", "renew1"), ("HAS_CLAUSE", "C1", "pay1"), ("HAS_CLAUSE", "C2", "renew2"), ("PROVIDES", "V1", "S1"), ("PROVIDES", "V2", "S2"),
    ("SUPPORTS", "S1", "A1"), ("SUPPORTS", "S1", "A2"), ("USES_PORTAL", "S2", "A1"), ("ENABLES", "A1", "P1"), ("ENABLES", "A2", "P1"), ("ASSESSES", "R1", "V1"), ("RAISED_IN", "I1", "R1"), ("AFFECTS", "I1", "A1"), ("AFFECTS", "I1", "S1"),
]


def test_frontiers(spark):
    edges = graph(spark, TRIPLES)

    def reach(start, *steps):
        return sorted(r.node for r in traverse.frontier(spark.createDataFrame([(start,)], "key string"), edges, steps).collect())

    assert reach("V1", ("PARTY_TO", OUT), ("HAS_CLAUSE", OUT)) == ["pay1", "renew1"]
    assert reach("V1", ("PROVIDES", OUT), ("SUPPORTS", OUT)) == ["A1", "A2"]
    assert reach("V2", ("PROVIDES", OUT), ("SUPPORTS", OUT)) == [] and reach("V2", ("PROVIDES", OUT), ("USES_PORTAL", OUT)) == ["A1"]
    assert reach("V1", ("PROVIDES", OUT), ("SUPPORTS", OUT), ("ENABLES", OUT)) == ["P1"]
    assert reach("V1", ("ASSESSES", IN), ("RAISED_IN", IN), ("AFFECTS", OUT)) == ["A1", "S1"]


def test_paths_keep_every_route_and_focus_filters(spark):
    edges = graph(spark, TRIPLES)
    start = spark.createDataFrame([("V1",), ("V2",)], "key string")
    paths = traverse.expand_paths(start, edges, [("PROVIDES", OUT), (["SUPPORTS", "USES_PORTAL"], OUT), ("ENABLES", OUT)])
    assert sorted(map(tuple, (r.path_nodes for r in paths.collect()))) == [("V1", "S1", "A1", "P1"), ("V1", "S1", "A2", "P1"), ("V2", "S2", "A1", "P1")]
    nodes = spark.createDataFrame([("renew1", "RenewalClause"), ("renew2", "RenewalClause"), ("pay1", "PaymentTermsClause")], "key string, class_id string")
    tagged = traverse.collections(start, edges, {"contracts": [("PARTY_TO", OUT)], "clauses": [("PARTY_TO", OUT), ("HAS_CLAUSE", OUT)]})
    assert sorted(r.end for r in traverse.focus(tagged, nodes, "clauses", "RenewalClause").collect()) == ["renew1", "renew2"]


def test_bfs_depth_direction_and_filters(spark):
    edges = graph(spark, TRIPLES)
    start = spark.createDataFrame([("V1",)], "key string")
    depth = {r.node: r.depth for r in traverse.bfs(start, edges, 2).collect()}
    assert depth == {"V1": 0, "C1": 1, "S1": 1, "renew1": 2, "pay1": 2, "A1": 2, "A2": 2}
    assert {r.node for r in traverse.bfs(start, edges, 5, types=["PROVIDES"]).collect()} == {"V1", "S1"}
    both_ways = {r.node: r.predecessor for r in traverse.bfs(start, edges, 1, directed=False).collect()}
    assert both_ways == {"V1": None, "C1": "V1", "S1": "V1", "R1": "V1"}


def test_relation_path_prefers_directions(spark):
    rules = spark.createDataFrame([("Vendor", "PROVIDES", "Service"), ("Service", "SUPPORTS", "Application"), ("Risk", "ASSESSES", "Vendor")], "source string, type string, target string")
    assert traverse.relation_path(rules, "Risk", "Application").first().path == "Risk -ASSESSES-> Vendor -PROVIDES-> Service -SUPPORTS-> Application"
    assert traverse.relation_path(rules, "Application", "Risk").first().path == "Application <-SUPPORTS- Service <-PROVIDES- Vendor <-ASSESSES- Risk"
    assert traverse.relation_path(rules, "Application", "Nowhere").count() == 0


SMALL = Ontology(
    classes=(
        BusinessClass("Party", properties=(Property("name", synonyms=("Vendor_Name",)),)),
        BusinessClass("Vendor", key="vendor_id", id_pattern="V-[0-9]{3}", parent="Party", properties=(Property("vendor_id", "identifier", required=True, synonyms=("Vendor_ID",)),)),
        BusinessClass("Contract", key="contract_id", id_pattern="CTR-[0-9]{3}", properties=(Property("contract_id", "identifier", required=True),)), BusinessClass("Clause", key="clause_id", properties=(Property("clause_id", "identifier"),)),
    ),
    relations=(
        Relation("PARTY_TO", "Party", "Contract"), Relation("PRIME", "Party", "Contract", "one_to_one"), Relation("A", "Contract", "Contract", disjoint_with=("B",)), Relation("B", "Contract", "Contract"), Relation("HAS_CLAUSE", "Contract", "Clause"),
    ),
)


def test_mapping_uses_synonyms_and_rejects_bad_columns(spark):
    df = spark.createDataFrame([("V-001", "Aurelix"), ("V-002", None)], "Vendor_ID string, Vendor_Name string")
    rows = {r.identity: r for r in build.map_nodes(df, "Vendor", "ns", SMALL).collect()}
    assert rows["V-001"].props == {"name": "Aurelix", "vendor_id": "V-001"} and rows["V-002"].props == {"vendor_id": "V-002"} and rows["V-001"].labels == "Vendor,Party"
    import hashlib

    assert rows["V-001"].key == hashlib.sha256(b'["entity","ns","Vendor","V-001"]').hexdigest()
    for bad in (df.withColumn("other", F.lit(1)), df.withColumn("name", F.lit("x")), df.select("Vendor_Name")):
        with pytest.raises(ValueError):
            build.map_nodes(bad, "Vendor", "ns", SMALL)


def base(spark):
    nodes = spark.createDataFrame([("v1", "Vendor", "V-001", None), ("v2", "Vendor", "V-002", None), ("c1", "Contract", "CTR-001", None), ("c2", "Contract", "CTR-002", None), ("k1", "Clause", "x", "CTR-001")], "key string, class_id string, identity string, contract_identity string")
    return nodes, [("PARTY_TO", "v1", "c1"), ("PARTY_TO", "v2", "c1"), ("PRIME", "v1", "c1"), ("A", "c1", "c2"), ("HAS_CLAUSE", "c1", "k1")]


def test_topology_reports_exactly_the_breach(spark):
    nodes, triples = base(spark)
    codes = lambda extra_nodes, extra, refs=(): sorted({r.code for r in build.topology_report(nodes.unionByName(extra_nodes) if extra_nodes else nodes, graph(spark, triples + extra), SMALL, spark.createDataFrame(list(refs), "subject string, reference string") if refs else None).collect()})
    assert codes(None, []) == []
    assert codes(None, [("PARTY_TO", "v1", "gone")]) == ["missing_endpoint"]
    assert codes(None, [("PARTY_TO", "c1", "c2")]) == ["invalid_relationship"]
    assert codes(None, [("PRIME", "v1", "c2")]) == ["cardinality"] and codes(None, [("PRIME", "v2", "c1")]) == ["cardinality"]
    assert codes(None, [("B", "c1", "c2")]) == ["disjoint_relationships"]
    assert codes(None, [("HAS_CLAUSE", "c2", "k1")]) == ["clause_contract"]
    assert codes(nodes.limit(1), []) == ["duplicate_node"] and codes(None, [("A", "c1", "c2")]) == ["duplicate_relationship"]
    assert codes(None, [], [("v1", "c1"), ("v1", "nope")]) == ["missing_reference"]


def test_merge_needs_newer_revisions_and_replay_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x")], "key string, revision bigint, content string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 2, "y"), ("d", 1, "z")], "key string, revision bigint, content string")
    decided = build.merge(old, new, F.col("content"))
    assert {r.key: r.action for r in decided.collect()} == {"a": "unchanged", "b": "update", "c": "stale", "d": "insert"}
    good = new.filter("key <> 'c'")
    merged = build.apply_merge(old, good, build.merge(old, good, F.col("content")))
    assert {r.key: r.content for r in merged.collect()} == {"a": "x", "b": "y", "c": "x", "d": "z"}
    again = build.merge(merged, good, F.col("content"))
    assert {r.action for r in again.collect()} == {"keep", "unchanged"}


def test_entity_keys_escape_like_compact_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([('He said "é/ü"',)], "v string")
    want = hashlib.sha256(json.dumps(["entity", "n", "C", 'He said "é/ü"'], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert df.select(entity_key("n", "C", F.col("v"))).first()[0] == want


def test_relation_path_has_no_depth_bound(spark):
    chain = spark.createDataFrame([(f"C{i}", "LEADS_TO", f"C{i + 1}") for i in range(14)], "source string, type string, target string")
    found = traverse.relation_path(chain, "C0", "C14").first()
    assert found.steps == 14 and found.path.endswith("-> C14") and traverse.relation_path(chain, "C14", "C0").first().steps == 14


def test_patterns_with_shared_prefixes(spark):
    edges = spark.createDataFrame([(f"a{i}", "X", "r", f"m{i}") for i in range(3)] + [(f"b{i}", "Y", f"m{i}", f"e{i}") for i in range(3)] + [("c", "Z", "e1", "f")], "key string, type string, src string, dst string")
    start = spark.createDataFrame([("r",)], "key string")
    named = {"one": [("X", OUT)], "two": [("X", OUT), ("Y", OUT)], "three": [("X", OUT), ("Y", OUT), ("Z", OUT)], "same": [("X", OUT), ("Y", OUT)], "back": [("Z", "in")]}
    got = {}
    for r in traverse.collections(start, edges, named).collect():
        got.setdefault(r.collection, []).append(tuple(r.path_nodes))
    assert {k: sorted(v) for k, v in got.items()} == {"one": [("r", f"m{i}") for i in range(3)], "two": [("r", f"m{i}", f"e{i}") for i in range(3)], "same": [("r", f"m{i}", f"e{i}") for i in range(3)], "three": [("r", "m1", "e1", "f")]}


def test_long_chains_settle(spark):
    n = 200
    edges = spark.createDataFrame([(f"k{i:04d}", f"k{i + 1:04d}") for i in range(n) if i != 120], "src string, dst string")
    nodes = spark.createDataFrame([(f"k{i:04d}",) for i in range(n + 2)], "key string")
    got = {r.key: r.component for r in traverse.connected_components(nodes, edges).collect()}
    assert all(got[f"k{i:04d}"] == ("k0000" if i <= 120 else "k0121" if i <= n else f"k{i:04d}") for i in range(n + 2))


def test_bounded_collections_equal_cut_whole_walks(spark):
    """Limits per root and collection, with hubs on both ends, parallel edges and prefixes that lead nowhere."""
    triples = [("A", f"r{i % 4}", f"m{i}") for i in range(60)] + [("B", f"m{i}", f"e{j}") for i in range(0, 60, 7) for j in range(i % 5)]
    triples += [("B", "m1", f"e{j}") for j in range(200)] + [("C", f"x{i}", f"e{i % 9}") for i in range(40)] + [("A", "r9", "m1"), ("A2", "r1", "m1")]
    edges = graph(spark, triples).unionByName(spark.createDataFrame([("second", "A", "r1", "m1")], "key string, type string, src string, dst string"))
    start = spark.createDataFrame([(f"r{i}",) for i in range(10)], "key string")
    named = {"one": [("A", OUT)], "two": [(("A", "A2"), OUT), ("B", OUT)], "three": [("A", OUT), ("B", OUT), ("C", IN)], "none": [("B", OUT)]}
    whole = traverse.collections(start, edges, named).collect()
    for limit in (1, 3, 10_000):
        got = {}
        for r in traverse.bounded_collections(start, edges, named, limit).collect():
            got.setdefault((r.collection, r.root), []).append((r.path_nodes, r.path_edges, r.truncated))
        want = {}
        for r in whole:
            want.setdefault((r.collection, r.root), []).append((r.path_nodes, r.path_edges))
        want = {k: [(*p, len(v) > limit) for p in sorted(v)[:limit]] for k, v in want.items()}
        assert {k: sorted(v) for k, v in got.items()} == want


def citation(**given):
    names = [f.split(":")[0] for f in evidence.CITATION.removeprefix("struct<").removesuffix(">").split(",")]
    return tuple({"review_state": "approved", "source_ref": "file"}.get(n) if n not in given else given[n] for n in names)


def test_citations_are_checked_and_canonical(spark):
    doc = {"document_class": "Document", "document_id": "7"}
    wrong = {
        "review_state": [{"review_state": None}, {"review_state": "Approved"}], "property": [{"property_id": "colour"}], "text": [{"source_ref": ""}, {"evidence_ref": " x"}, {"extraction_run": "x\n"}],
        "page": [{**doc, "page": 0}, {**doc, "page": -3}], "confidence": [{"confidence": 1.01}, {"confidence": float("nan")}, {"confidence": float("-inf")}], "document_class": [{"document_class": "Order", "document_id": "7"}, {"document_class": None, "document_id": "7"}],
        "location_without_document": [{"page": 2}, {"section": "4"}, {"chunk_id": "c"}], "nothing_cited": [{"source_ref": None}],
    }
    cases = [(f"{code}{i}", [citation(), citation(**c)], code) for code, list_ in wrong.items() for i, c in enumerate(list_)]
    fine = [citation(**doc, page=3), citation(), citation(**doc, page=1, confidence=0.0), citation(), citation(evidence_ref="e", source_ref=None, confidence=1.0, property_id="total")]
    rows = [(k, v) for k, v, _ in cases] + [("fine", fine), ("again", fine[::-1] + fine), ("empty", []), ("null", None)]
    df = evidence.checked(spark.createDataFrame(rows, f"subject_key string, citations array<{evidence.CITATION}>"), ["total"], ["Document"])
    got = {r.subject_key: r for r in df.collect()}
    for key, _, code in cases:
        assert [(v.position, v.code) for v in got[key].violations] == [(2, code)] and got[key].citations is None
    assert got["fine"].citations == got["again"].citations and len(got["fine"].citations) == 4
    assert got["fine"].violations == [] and got["empty"].citations == [] and got["null"].citations is None
    listed = evidence.listed(df.filter("subject_key = 'fine'"), "ns").orderBy("position").collect()
    assert [r.position for r in listed] == [1, 2, 3, 4]
    assert [r.document_key is not None for r in listed].count(True) == 2 and spark.createDataFrame([("7",)], "i string").select(entity_key("ns", "Document", F.col("i"))).first()[0] in {r.document_key for r in listed}


def test_evidence_of_nodes_and_relationships(spark):
    asked = spark.createDataFrame([("node", "N1"), ("edge", "E1"), ("edge", "N1"), ("node", "gone"), ("node", "N2"), ("node", "N1")], "kind string, key string")
    nodes, found = spark.createDataFrame([("N1",), ("N2",)], "key string"), spark.createDataFrame([("E1",)], "key string")
    cites = spark.createDataFrame([("N1", 1, "D1"), ("N1", 2, None), ("N1", 3, "D2"), ("E1", 1, "D9"), ("E1", 2, "D1"), ("gone", 1, "D1")], "subject_key string, position int, document_key string")
    docs = spark.createDataFrame([("D1",), ("D2",)], "key string")
    proven = graph(spark, [("EVIDENCED_BY", "N1", "D2"), ("EVIDENCED_BY", "N1", "D1"), ("EVIDENCED_BY", "N1", "D3"), ("EVIDENCED_BY", "E1", "D1"), ("OTHER", "N2", "D1")])
    got = {(r.kind, r.subject_key, r.part, r.position, r.item_key, r.truncated) for r in evidence.lookup(asked, nodes, found, cites, docs, proven, 2).collect()}
    assert got == {
        ("node", "N1", "subject", 1, "N1", False), ("edge", "E1", "subject", 1, "E1", False), ("edge", "N1", "subject", 1, None, False), ("node", "gone", "subject", 1, None, False), ("node", "N2", "subject", 1, "N2", False),
        ("node", "N1", "citation", 1, "D1", True), ("node", "N1", "citation", 2, None, True), ("edge", "E1", "citation", 1, "D9", False), ("edge", "E1", "citation", 2, "D1", False),
        ("node", "N1", "document", 1, "D1", False), ("edge", "E1", "document", 1, "D1", False), ("node", "N1", "evidenced_by", 1, "D1", True), ("node", "N1", "evidenced_by", 2, "D2", True),
    }


def test_paths_end_when_their_edges_are_never_in_effect_together(spark):
    """Against all walks written out: open ends, touching days, contained intervals, cycles, filters, dead edges."""
    from datetime import date
    from itertools import product

    day = lambda n: None if n is None else date(2024, 1, n)
    rows = [
        ("a", "b", 1, 10), ("a", "b", 3, 5), ("a", "b", 8, 20), ("b", "c", 10, 12), ("b", "c", None, 2), ("b", "c", 21, None), ("c", "a", 1, 30), ("a", "c", 11, 11), ("c", "d", None, None), ("d", "e", 9, 3),
        ("d", "f", 2, 2), ("b", "x", 1, 30), ("f", "g", 2, None), (None, "b", 1, 2), ("c", "c", 1, 30), ("a", "b", 1, 10),
    ]
    edges = spark.createDataFrame([(s, t, "R", day(f), day(u)) for s, t, f, u in rows], "src string, dst string, type string, valid_from date, valid_to date")
    start = spark.createDataFrame([("a",), ("d",), ("nowhere",)], "key string")
    entered = spark.createDataFrame([(k,) for k in "abcdefg"], "key string")

    def brute(depth):
        low, high = 0, 99
        found = {(r, r): [(0, low, high)] for r in ("a", "d", "nowhere")}
        level = [(r, r, low, high) for r in ("a", "d", "nowhere")]
        for d in range(1, depth + 1):
            walked = {(r, t, max(f, low if ef is None else ef), min(u, high if eu is None else eu)) for (r, n, f, u), (s, t, ef, eu) in product(level, rows) if s == n and t in "abcdefg" and (ef or low) <= (high if eu is None else eu)}
            walked = {w for w in walked if w[2] <= w[3]}
            kept = {w for w in walked if not any(o != w and o[:2] == w[:2] and o[2] <= w[2] and o[3] >= w[3] for o in walked) and not any(f <= w[2] and u >= w[3] for _, f, u in found.get(w[:2], []))}
            for r, n, f, u in kept:
                found.setdefault((r, n), []).append((d, f, u))
            level = list(kept)
        return {(r, n, d, day(f or None), day(None if u == high else u)) for (r, n), xs in found.items() for d, f, u in xs}

    for depth in (0, 1, 3, 6):
        got = traverse.bfs_in_time(start, edges, depth, types=["R"], node_filter=entered, edge_filter=F.col("src").isNotNull()).collect()
        assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == brute(depth), depth
    assert traverse.bfs_in_time(start.limit(0), edges, 3).count() == 0 and traverse.bfs_in_time(start, edges.limit(0), 3).count() == 3


def test_relation_paths_of_all_pairs(spark):
    chain = [(f"C{i:02d}", "LEADS_TO", f"C{i + 1:02d}", 10 + i) for i in range(9)]
    rows = [*chain, ("C00", "SKIPS", "C05", 3), ("C00", "ALSO", "C05", 4), ("C02", "SELF", "C02", 1)]
    relations = spark.createDataFrame(rows, "source string, type string, target string, weight bigint")
    got = {(r.source, r.target): r for r in traverse.relation_paths(relations).collect()}
    assert len(got) == 90 and all(s != t for s, t in got)
    assert got["C00", "C05"].path == "C00 -ALSO-> C05" and got["C00", "C05"].weight == 4
    assert (got["C01", "C09"].steps, got["C01", "C09"].directed, got["C01", "C09"].weight) == (8, True, 11)
    assert got["C05", "C00"].path == "C05 <-ALSO- C00" and not got["C05", "C00"].directed
    for source, target in (("C00", "C09"), ("C09", "C03"), ("C04", "C00")):
        single = traverse.relation_path(relations, source, target).first()
        assert (single.path, single.steps) == (got[source, target].path, got[source, target].steps)
