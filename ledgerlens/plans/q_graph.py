"""Graph queries: the star schema as entities and relationships in one namespace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.identity import clause_key, clause_key_of, entity_key, entity_key_of, order_of, short_clause_key, short_key, short_relationship_key, with_canonical
from ledgerlens.operators import ranking
from ledgerlens.operators.graph import build, evidence, traverse
from ledgerlens.plans import q_risk
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import AS_OF, CONTRACTS, MEASUREMENTS, assessments, contracts, table, with_sql
from ledgerlens.plans.vocabulary import VOCABULARY

NS = "portfolio"
IN, OUT = traverse.IN, traverse.OUT


# ---------------------------------------------------------------- graph frames
def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"))


def node_parts(spark, folder, short: bool = False) -> dict[str, DataFrame]:
    money = lambda c: F.col(c).cast("decimal(12,2)").alias(c)
    t = lambda name: table(spark, folder, name)
    records = {
        "Region": t("region").select("r_regionkey"), "Nation": t("nation").select("n_nationkey"),
        "Supplier": t("supplier").select("s_suppkey", F.col("s_name").alias("display_name"), money("s_acctbal")),
        "Customer": t("customer").select("c_custkey", F.col("c_name").alias("display_name"), "c_mktsegment"),
        "Part": t("part").select("p_partkey", "p_size", money("p_retailprice"), "p_type"), "Order": orders(spark, folder),
    }
    return {c: build.map_nodes(df, c, NS, VOCABULARY, short=short) for c, df in records.items()}


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(spark, folder):
    return union(node_parts(spark, folder).values())


def edges(spark, folder, types: set[str] | None = None, short: bool = False, ranged: bool = False):
    t = lambda name: table(spark, folder, name)
    lines = t("lineitem")
    specs = [
        ("IN_REGION", "Nation", "Region", lambda: t("nation"), "n_nationkey", "n_regionkey"), ("LOCATED_IN", "Supplier", "Nation", lambda: t("supplier"), "s_suppkey", "s_nationkey"),
        ("LOCATED_IN", "Customer", "Nation", lambda: t("customer"), "c_custkey", "c_nationkey"), ("OWNED_BY", "Order", "Customer", lambda: t("orders"), "o_orderkey", "o_custkey"),
        ("DELIVERS", "Supplier", "Order", lambda: lines, "l_suppkey", "l_orderkey"), ("SUPPORTS", "Supplier", "Part", lambda: lines.filter("l_returnflag <> 'R'"), "l_suppkey", "l_partkey"),
        ("USES_PORTAL", "Supplier", "Part", lambda: lines.filter("l_returnflag = 'R'"), "l_suppkey", "l_partkey"),
    ]
    # An order has one owner; an owner, a vendor or a nation has many edges.
    many = lambda r: ("target" if r in ("OWNED_BY", "LOCATED_IN", "IN_REGION") else "source") if ranged else None
    return union([build.map_edges(frame(), r, a, b, s, d, NS, short=short, ranged=many(r)) for r, a, b, frame, s, d in specs if types is None or r in types])


def entity(cls: str, column: str):
    return entity_key(NS, cls, F.col(column))


def ek(cls: str, expr: str) -> str:
    return f"sha256(CAST(to_json(['entity', '{NS}', '{cls}', CAST({expr} AS VARCHAR)]) AS VARCHAR))"


def rk(relation: str, a: str, b: str) -> str:
    return f"sha256(CAST(to_json(['relationship', '{NS}', '{relation}', {a}, {b}]) AS VARCHAR))"


def ck(contract: str, cls: str, occurrence: str) -> str:
    return f"sha256(CAST(to_json(['clause', '{NS}', CAST({contract} AS VARCHAR), {cls}, {occurrence}]) AS VARCHAR))"


def _props(*pairs: str) -> str:
    return "concat_ws(';', " + ", ".join(f"'{p.split(':')[0]}=' || {p.split(':', 1)[1]}" for p in sorted(pairs)) + ")"


_NODE_SQL = {
    "Region": ("region", "r_regionkey", "Region", _props("region_id:r_regionkey")),
    "Nation": ("nation", "n_nationkey", "Nation", _props("nation_id:n_nationkey")),
    "Supplier": ("supplier", "s_suppkey", "Supplier,Party", _props("supplier_id:s_suppkey", "display_name:s_name", "balance:CAST(s_acctbal AS DECIMAL(12,2))")),
    "Customer": ("customer", "c_custkey", "Customer,Party", _props("customer_id:c_custkey", "display_name:c_name", "segment:c_mktsegment")),
    "Part": ("part", "p_partkey", "Part", _props("part_id:p_partkey", "size:p_size", "price:CAST(p_retailprice AS DECIMAL(12,2))", "type:p_type")),
    "Order": ("orders", "o_orderkey", "Order", _props("order_id:o_orderkey", "status:o_orderstatus", "total:CAST(o_totalprice AS DECIMAL(12,2))", "date:CAST(o_orderdate AS DATE)")),
}
NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT {ek(c, key)} AS key, '{c}' AS class_id, '{labels}' AS labels, CAST({key} AS VARCHAR) AS identity, CAST(1 AS BIGINT) AS revision, {props} AS props FROM {t}" for c, (t, key, labels, props) in _NODE_SQL.items()) + ")"
_EDGE_SQL = [
    ("IN_REGION", "Nation", "Region", "nation", "n_nationkey", "n_regionkey"), ("LOCATED_IN", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey"), ("LOCATED_IN", "Customer", "Nation", "customer", "c_custkey", "c_nationkey"),
    ("OWNED_BY", "Order", "Customer", "orders", "o_orderkey", "o_custkey"), ("DELIVERS", "Supplier", "Order", "lineitem", "l_suppkey", "l_orderkey"),
    ("SUPPORTS", "Supplier", "Part", "lineitem WHERE l_returnflag <> 'R'", "l_suppkey", "l_partkey"), ("USES_PORTAL", "Supplier", "Part", "lineitem WHERE l_returnflag = 'R'", "l_suppkey", "l_partkey"),
]
PAIRS = "ends AS (" + " UNION ALL ".join(f"SELECT '{r}' AS type, {ek(a, 's')} AS src, {ek(b, 't')} AS dst FROM (SELECT DISTINCT {s} AS s, {d} AS t FROM {frm})" for r, a, b, frm, s, d in _EDGE_SQL) + ")"
EDGES = f"edges AS (SELECT sha256(CAST(to_json(['relationship', '{NS}', type, src, dst]) AS VARCHAR)) AS key, type, src, dst FROM ends)"


# --------------------------------------------------------------- construction
CLAUSE_CLASS = {"1-URGENT": "RenewalClause", "2-HIGH": "RenewalClause", "3-MEDIUM": "PaymentTermsClause", "4-NOT SPECIFIED": "TerminationClause", "5-LOW": "NoticeClause"}


def short_clauses(spark, folder):
    """One clause per contract, its class given by the contract's priority, without a canonical key."""
    kind = F.create_map(*[F.lit(v) for pair in CLAUSE_CLASS.items() for v in pair])[F.col("priority")]
    return contracts(spark, folder).select(F.col("contract_id").cast("string").alias("contract_identity"), kind.alias("class_id"), F.lit("occ1").alias("identity"))


def clauses(spark, folder):
    rows = short_clauses(spark, folder)
    return rows.select(clause_key(NS, F.col("contract_identity"), F.col("class_id"), F.col("identity")).alias("key"), "class_id", "identity", "contract_identity")


CLAUSES = "clauses AS (SELECT {key} AS key, class_id, 'occ1' AS identity, contract_identity FROM (SELECT CAST(contract_id AS VARCHAR) AS contract_identity, CASE priority {whens} END AS class_id FROM contracts))".format(
    key=ck("contract_identity", "class_id", "'occ1'"), whens=" ".join(f"WHEN '{p}' THEN '{c}'" for p, c in CLAUSE_CLASS.items())
)


@query("graph_keys", with_sql(NODES, CONTRACTS, CLAUSES) + "SELECT class_id, identity, key FROM nodes UNION ALL SELECT class_id, contract_identity || '/' || identity, key FROM clauses")
def graph_keys(spark, folder):
    named = clauses(spark, folder).select("class_id", F.concat_ws("/", "contract_identity", "identity").alias("identity"), "key")
    return nodes(spark, folder).select("class_id", "identity", "key").unionByName(named)


@query("graph_nodes_edges", with_sql(NODES) + f"SELECT key, '{NS}' AS namespace, class_id, labels, identity, revision, props FROM nodes")
def graph_nodes_edges(spark, folder):
    return nodes(spark, folder).withColumn("props", build.props_text(F.col("props")))


@query("graph_edges", with_sql(PAIRS, EDGES) + f"SELECT key, '{NS}' AS namespace, type, src, dst, CAST(1 AS BIGINT) AS revision FROM edges")
def graph_edges(spark, folder):
    return edges(spark, folder, ranged=True).drop("src_class", "dst_class")


@query("graph_counts", with_sql(NODES, PAIRS) + "SELECT 'node' AS kind, class_id AS name, count(*) AS records FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM ends GROUP BY 2")
def graph_counts(spark, folder):
    return build.counts(nodes(spark, folder), edges(spark, folder))


def content(df):
    return df.withColumn("content", build.props_text(F.col("props"))).select("key", "revision", "content")


def next_version(spark, folder):
    """Orders again: closed ones changed with a newer revision, pending ones changed without one; plus all parts."""
    parts = node_parts(spark, folder)
    changed = content(parts["Order"]).withColumn("status", F.regexp_extract("content", "status=(.)", 1))
    changed = changed.select("key", F.when(F.col("status") == "F", 2).otherwise(1).cast("long").alias("revision"), F.when(F.col("status") == "O", F.col("content")).otherwise(F.concat("content", F.lit(";amended"))).alias("content"))
    return changed.unionByName(content(parts["Part"]))


def stored_version(spark, folder):
    parts = node_parts(spark, folder)
    return content(union([parts["Supplier"], parts["Order"]]))


VERSIONS = (
    "stored AS (SELECT key, revision, props AS content FROM nodes WHERE class_id IN ('Supplier', 'Order'))",
    "incoming AS (SELECT key, CAST(CASE WHEN contains(props, 'status=F') THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN contains(props, 'status=O') THEN props ELSE props || ';amended' END AS content FROM nodes WHERE class_id = 'Order' UNION ALL SELECT key, revision, props FROM nodes WHERE class_id = 'Part')",
    "both_sides AS (SELECT coalesce(s.key, i.key) AS key, s.revision AS old_revision, i.revision AS new_revision, s.content AS oc, i.content AS nc FROM stored s FULL OUTER JOIN incoming i ON s.key = i.key)",
)


@query(
    "graph_merge",
    with_sql(NODES, *VERSIONS)
    + "SELECT key, old_revision, new_revision, CASE WHEN new_revision IS NULL THEN 'keep' WHEN old_revision IS NULL THEN 'insert' WHEN oc = nc AND old_revision = new_revision THEN 'unchanged' WHEN new_revision > old_revision THEN 'update' ELSE 'stale' END AS action FROM both_sides",
)
def graph_merge(spark, folder):
    return build.merge(stored_version(spark, folder), next_version(spark, folder), F.col("content"))


@query(
    "graph_reconcile",
    with_sql(NODES, *VERSIONS)
    + "SELECT count(oc) AS expected, count(nc) AS actual, count(*) FILTER (oc = nc) AS matched, count(*) FILTER (nc IS NULL) AS missing, count(*) FILTER (oc <> nc) AS differing, count(*) FILTER (oc IS NULL) AS unexpected FROM both_sides",
)
def graph_reconcile(spark, folder):
    return build.reconcile(stored_version(spark, folder), next_version(spark, folder), F.col("content"))


@query("graph_diff", with_sql(NODES, *VERSIONS) + "SELECT key, CASE WHEN oc IS NULL THEN 'added' WHEN nc IS NULL THEN 'removed' ELSE 'changed' END AS change FROM both_sides WHERE oc IS NULL OR nc IS NULL OR oc <> nc")
def graph_diff(spark, folder):
    return build.graph_diff(stored_version(spark, folder), next_version(spark, folder), F.col("content"))


@query(
    "latest_revision",
    "SELECT user_id, event_id, event_type, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_revision(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    return ranking.latest_revision(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "graph_topology",
    with_sql(
        NODES, PAIRS, EDGES, "kept AS (SELECT key, class_id FROM nodes WHERE NOT contains(props, 'status=P') UNION ALL SELECT key, class_id FROM nodes WHERE class_id = 'Region')",
        "known AS (SELECT DISTINCT key, class_id FROM kept)", "valid AS (SELECT e.* FROM edges e JOIN known s ON e.src = s.key JOIN known d ON e.dst = d.key)",
    )
    + "SELECT 'duplicate_node' AS code, key AS subject FROM kept GROUP BY key HAVING count(*) > 1"
    " UNION ALL SELECT 'missing_endpoint', e.key FROM edges e LEFT JOIN known s ON e.src = s.key LEFT JOIN known d ON e.dst = d.key WHERE s.key IS NULL OR d.key IS NULL"
    f" UNION ALL SELECT DISTINCT 'missing_reference', {ek('Customer', 'o_custkey')} FROM orders WHERE {ek('Order', 'o_orderkey')} NOT IN (SELECT key FROM known)"
    " UNION ALL SELECT 'cardinality', dst FROM valid WHERE type = 'DELIVERS' GROUP BY dst HAVING count(*) > 1"
    " UNION ALL SELECT 'disjoint_relationships', src || '->' || dst FROM valid WHERE type IN ('SUPPORTS', 'USES_PORTAL') GROUP BY src, dst HAVING count(*) > 1",
)
def graph_topology(spark, folder):
    """Pending orders are left out of the nodes and regions come twice, so that edges and references dangle and keys repeat."""
    parts = node_parts(spark, folder, short=True)
    kept = union([*parts.values(), parts["Region"]]).filter(F.coalesce(F.col("props")["status"], F.lit("")) != "P")
    references = table(spark, folder, "orders").select(short_key("Customer", F.col("o_custkey")).alias("subject"), short_key("Order", F.col("o_orderkey")).alias("reference"))
    report = build.topology_report(kept, edges(spark, folder, short=True), VOCABULARY, references, short_relationship_key)
    # Checked under short keys; the report names its subjects canonically.
    of_edge = F.col("code").isin("duplicate_relationship", "missing_endpoint", "invalid_relationship")
    disjoint = F.col("code") == "disjoint_relationships"
    ends = F.split("subject", "->")
    named = with_canonical(report.filter(~disjoint), NS, "subject", of_edge)
    return named.unionByName(report.filter(disjoint).withColumn("subject", F.concat_ws("->", entity_key_of(NS, ends[0]), entity_key_of(NS, ends[1]))))


# ----------------------------------------------------------------------- paths
def hashed(paths):
    """Paths under short keys with canonical ends, and a digest of the canonical keys along them."""
    canonical = paths.withColumn("_nodes", F.transform("path_nodes", lambda k: entity_key_of(NS, k)))
    return canonical.select("collection", F.element_at("_nodes", 1).alias("root"), F.element_at("_nodes", -1).alias("end"), F.sha2(F.array_join("_nodes", ">"), 256).alias("path"))


def walked_short(edges):
    """On a path under short keys, an edge between two nodes is told by its type."""
    return edges.withColumn("key", F.col("type"))


@query(
    "graph_path_dependencies",
    with_sql(
        PAIRS, "d AS (SELECT src, dst FROM ends WHERE type = 'DELIVERS')", "o AS (SELECT src, dst FROM ends WHERE type = 'OWNED_BY')", "l AS (SELECT src, dst FROM ends WHERE type = 'LOCATED_IN')",
    )
    + "SELECT 'orders' AS collection, d.src AS root, d.dst AS end, sha256(d.src || '>' || d.dst) AS path FROM d UNION ALL SELECT 'owners', d.src, o.dst, sha256(d.src || '>' || d.dst || '>' || o.dst) FROM d JOIN o ON d.dst = o.src"
    " UNION ALL SELECT 'nations', d.src, l.dst, sha256(d.src || '>' || d.dst || '>' || o.dst || '>' || l.dst) FROM d JOIN o ON d.dst = o.src JOIN l ON o.dst = l.src".replace(" AS end,", ' AS "end",'),
)
def graph_path_dependencies(spark, folder):
    start = node_parts(spark, folder, short=True)["Supplier"]
    hops = [("DELIVERS", OUT), ("OWNED_BY", OUT), ("LOCATED_IN", OUT)]
    walked = walked_short(edges(spark, folder, {"DELIVERS", "OWNED_BY", "LOCATED_IN"}, short=True))
    parts = build.PARTS_PER_SPLIT * table(spark, folder, "lineitem").rdd.getNumPartitions()
    return hashed(traverse.collections(start, walked, {"orders": hops[:1], "owners": hops[:2], "nations": hops}, parts))


@query(
    "graph_path_clauses",
    with_sql(CONTRACTS, CLAUSES) + f"SELECT {ek('Order', 'contract_identity')} AS root, key AS \"end\", 2 AS path_length FROM clauses WHERE class_id IN ('RenewalClause', 'TerminationClause', 'PaymentTermsClause')",
)
def graph_path_clauses(spark, folder):
    start = node_parts(spark, folder, short=True)["Order"].select("key")
    named = short_clauses(spark, folder).select("class_id", "contract_identity", short_clause_key(F.col("contract_identity"), F.col("class_id"), F.col("identity")).alias("key"))
    owned = walked_short(named.select(F.lit("HAS_CLAUSE").alias("type"), short_key("Order", F.col("contract_identity")).alias("src"), F.col("key").alias("dst")))
    paths = traverse.expand_paths(start, owned, [("HAS_CLAUSE", OUT)], named, ["RenewalClause", "TerminationClause", "PaymentTermsClause"])
    return paths.select(entity_key_of(NS, F.col("root")).alias("root"), clause_key_of(NS, F.col("end")).alias("end"), F.size("path_nodes").alias("path_length"))


def risk_graph(spark, folder):
    """Assessments, service levels and measurements around the suppliers."""
    measured = q_risk.measured(spark, folder).select(
        F.concat_ws("-", F.lit("MET"), F.col("vendor_id").cast("string"), "period").alias("metric"), F.concat_ws("-", F.lit("SLA"), F.col("vendor_id").cast("string")).alias("sla"), "breach"
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.concat_ws("-", F.lit("SLA"), F.col("s_suppkey").cast("string")).alias("sla"))
    assessed = assessments(spark, folder)
    found = union([
        build.map_edges(assessed, "ASSESSES", "RiskAssessment", "Supplier", "assessment_id", "vendor_id", NS), build.map_edges(suppliers, "HAS_SLA", "Supplier", "ServiceLevelAgreement", "s_suppkey", "sla", NS),
        build.map_edges(measured, "MEASURED_AGAINST", "PerformanceMeasurement", "ServiceLevelAgreement", "metric", "sla", NS),
    ])
    ends = measured.select(entity("PerformanceMeasurement", "metric").alias("key"), F.lit("PerformanceMeasurement").alias("class_id"), "breach").unionByName(
        assessed.select(entity("RiskAssessment", "assessment_id").alias("key"), F.lit("RiskAssessment").alias("class_id")), allowMissingColumns=True
    )
    return found, ends


RISK_PATHS = {"vendor_assessments": [("ASSESSES", IN)], "slas": [("HAS_SLA", OUT)], "measurements": [("HAS_SLA", OUT), ("MEASURED_AGAINST", IN)]}
_S = ek("Supplier", "s_suppkey")
RISK_SQL = (
    MEASUREMENTS, q_risk.MEASURED,
    f"metrics AS (SELECT s_suppkey, {ek('ServiceLevelAgreement', chr(39) + 'SLA-' + chr(39) + ' || s_suppkey')} AS sla, {ek('PerformanceMeasurement', chr(39) + 'MET-' + chr(39) + ' || s_suppkey || ' + chr(39) + '-' + chr(39) + ' || period')} AS metric, breach FROM supplier JOIN measured ON vendor_id = s_suppkey)",
    f"paths AS (SELECT 'vendor_assessments' AS collection, {_S} AS root, {ek('RiskAssessment', chr(39) + 'RA-' + chr(39) + ' || doc_id')} AS e, NULL AS breach FROM supplier JOIN documents ON doc_id = s_suppkey"
    f" UNION ALL SELECT 'slas', {_S}, {ek('ServiceLevelAgreement', chr(39) + 'SLA-' + chr(39) + ' || s_suppkey')}, NULL FROM supplier UNION ALL SELECT 'measurements', {_S}, metric, breach FROM metrics)",
)


@query("graph_path_risk", with_sql(*RISK_SQL) + 'SELECT collection, root, e AS "end" FROM paths')
def graph_path_risk(spark, folder):
    walked, _ = risk_graph(spark, folder)
    return traverse.collections(node_parts(spark, folder)["Supplier"], walked, RISK_PATHS).select("collection", "root", "end")


@query("path_focus", with_sql(*RISK_SQL) + "SELECT root, e AS \"end\" FROM paths WHERE collection = 'measurements' AND breach")
def path_focus(spark, folder):
    walked, ends = risk_graph(spark, folder)
    paths = traverse.collections(node_parts(spark, folder)["Supplier"], walked, RISK_PATHS)
    return traverse.focus(paths, ends, "measurements", "PerformanceMeasurement", F.col("breach")).select("root", "end")


def contract_risk_graph(spark, folder):
    """Contracts with vendors, funded services and applications, and what assesses, raises, affects and measures them.

    Parts are services and brands applications; documents assess the vendor and the service of their number, and labels
    are issues raised in the assessment of their document, affecting vendor, service and its application.
    """
    t = lambda name: table(spark, folder, name)
    metrics = q_risk.measured(spark, folder).select(F.concat_ws("-", F.lit("MET"), F.col("vendor_id").cast("string"), "period").alias("metric"), F.col("vendor_id").alias("sla"))
    lines, docs, affected = t("lineitem"), t("documents"), t("labels").join(t("part"), F.col("doc_id") == F.col("p_partkey"))
    specs = [
        ("PARTY_TO", "Supplier", "Order", lines, "l_suppkey", "l_orderkey"), ("FUNDS", "Order", "Part", lines, "l_orderkey", "l_partkey"), ("SUPPORTS", "Part", "Brand", t("part"), "p_partkey", "p_brand"),
        ("HAS_SLA", "Part", "ServiceLevelAgreement", t("part").withColumn("sla", F.col("p_partkey")), "p_partkey", "sla"), ("MEASURED_AGAINST", "PerformanceMeasurement", "ServiceLevelAgreement", metrics, "metric", "sla"),
        ("ASSESSES", "RiskAssessment", "Supplier", docs.withColumn("vendor", F.col("doc_id")), "doc_id", "vendor"), ("ASSESSES", "RiskAssessment", "Part", docs.withColumn("service", F.col("doc_id")), "doc_id", "service"),
        ("RAISED_IN", "RiskIssue", "RiskAssessment", t("labels").withColumn("issue", F.col("doc_id")), "issue", "doc_id"), ("AFFECTS", "RiskIssue", "Supplier", t("labels").withColumn("vendor", F.col("doc_id")), "doc_id", "vendor"),
        ("AFFECTS", "RiskIssue", "Part", t("labels").withColumn("service", F.col("doc_id")), "doc_id", "service"), ("AFFECTS", "RiskIssue", "Brand", affected, "doc_id", "p_brand"),
    ]
    return walked_short(union([build.map_edges(frame, r, a, b, s, d, NS, short=True) for r, a, b, frame, s, d in specs]))


RISK_LIMIT = 3
_VENDOR, _SERVICE = [("PARTY_TO", IN)], [("FUNDS", OUT)]
_APPLICATION = [*_SERVICE, (("SUPPORTS", "USES_PORTAL"), OUT)]
CONTRACT_RISK = {
    "slas": [*_SERVICE, ("HAS_SLA", OUT)], "measurements": [*_SERVICE, ("HAS_SLA", OUT), ("MEASURED_AGAINST", IN)],
    "vendor_assessments": [*_VENDOR, ("ASSESSES", IN)], "vendor_assessment_issues": [*_VENDOR, ("ASSESSES", IN), ("RAISED_IN", IN)],
    "service_assessments": [*_SERVICE, ("ASSESSES", IN)], "service_assessment_issues": [*_SERVICE, ("ASSESSES", IN), ("RAISED_IN", IN)],
    "vendor_affected_issues": [*_VENDOR, ("AFFECTS", IN)], "service_affected_issues": [*_SERVICE, ("AFFECTS", IN)], "application_affected_issues": [*_APPLICATION, ("AFFECTS", IN)],
}


def _risk_steps_sql() -> str:
    k = lambda c, column: f"{ek(c, column)}"
    hops = {
        "party": f"SELECT DISTINCT {k('Order', 'l_orderkey')} AS a, {k('Supplier', 'l_suppkey')} AS b FROM lineitem", "funds": f"SELECT DISTINCT {k('Order', 'l_orderkey')} AS a, {k('Part', 'l_partkey')} AS b FROM lineitem",
        "runs": f"SELECT {k('Part', 'p_partkey')} AS a, {k('Brand', 'p_brand')} AS b FROM part", "sla": f"SELECT {k('Part', 'p_partkey')} AS a, {k('ServiceLevelAgreement', 'p_partkey')} AS b FROM part",
        "metric": f"SELECT {k('ServiceLevelAgreement', 'vendor_id')} AS a, {k('PerformanceMeasurement', chr(39) + 'MET-' + chr(39) + ' || vendor_id || ' + chr(39) + '-' + chr(39) + ' || period')} AS b FROM measured",
        "assessed": " UNION ALL ".join(f"SELECT DISTINCT {k(c, 'doc_id')} AS a, {k('RiskAssessment', 'doc_id')} AS b FROM documents" for c in ("Supplier", "Part")), "raised": f"SELECT DISTINCT {k('RiskAssessment', 'doc_id')} AS a, {k('RiskIssue', 'doc_id')} AS b FROM labels",
        "affected": " UNION ALL ".join(f"SELECT DISTINCT {k(c, 'doc_id')} AS a, {k('RiskIssue', 'doc_id')} AS b FROM labels" for c in ("Supplier", "Part")) + f" UNION ALL SELECT DISTINCT {k('Brand', 'p_brand')}, {k('RiskIssue', 'doc_id')} FROM labels JOIN part ON doc_id = p_partkey",
    }
    patterns = {
        "slas": "funds sla", "measurements": "funds sla metric", "vendor_assessments": "party assessed", "vendor_assessment_issues": "party assessed raised", "service_assessments": "funds assessed",
        "service_assessment_issues": "funds assessed raised", "vendor_affected_issues": "party affected", "service_affected_issues": "funds affected", "application_affected_issues": "funds runs affected",
    }
    parts = []
    for name, pattern in patterns.items():
        steps = pattern.split()
        joins = " ".join(f"JOIN {s} AS h{i} ON h{i - 1}.b = h{i}.a" for i, s in enumerate(steps) if i)
        trail = ", ".join(f"h{i}.b" for i in range(len(steps)))
        parts.append(f"SELECT '{name}' AS collection, h0.a AS root, h{len(steps) - 1}.b AS e, [h0.a, {trail}] AS nodes FROM {steps[0]} AS h0 {joins}")
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in hops.items())
    return with_sql(MEASUREMENTS, q_risk.MEASURED) + "SELECT * FROM (WITH " + ctes + " SELECT collection, root, e AS \"end\", sha256(array_to_string(nodes, '>')) AS path, n > 3 AS truncated FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY collection, root) AS n FROM (" + " UNION ALL ".join(parts) + ") WINDOW w AS (PARTITION BY collection, root ORDER BY nodes)) WHERE r <= 3)"


@query("graph_path_risk_bounded", _risk_steps_sql())
def graph_path_risk_bounded(spark, folder):
    """All nine collections around each contract, each with a limit and a flag of its own."""
    start = node_parts(spark, folder, short=True)["Order"].select("key")
    paths = traverse.bounded_collections(start, contract_risk_graph(spark, folder), CONTRACT_RISK, RISK_LIMIT, lambda k: order_of(NS, k))
    canonical = paths.withColumn("_nodes", F.transform("path_nodes", lambda k: entity_key_of(NS, k)))
    return canonical.select("collection", F.element_at("_nodes", 1).alias("root"), F.element_at("_nodes", -1).alias("end"), F.sha2(F.array_join("_nodes", ">"), 256).alias("path"), "truncated")


@query(
    "graph_frontier",
    f"SELECT {ek('Region', 'n_regionkey')} AS root, {ek('Order', 'o_orderkey')} AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def graph_frontier(spark, folder):
    start = node_parts(spark, folder)["Region"]
    return traverse.frontier(start, edges(spark, folder, {"IN_REGION", "LOCATED_IN", "OWNED_BY"}), [("IN_REGION", IN), ("LOCATED_IN", IN), ("OWNED_BY", IN)])


_R0 = ek("Region", "0")
_BFS_ENDS = "reach AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 0)"


@query(
    "graph_bfs",
    with_sql(
        _BFS_ENDS,
        f"hops AS (SELECT {ek('Order', 'o_orderkey')} AS node, {ek('Customer', 'o_custkey')} AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n FROM reach)"
        f" UNION ALL SELECT DISTINCT {ek('Order', 'l_orderkey')}, {ek('Supplier', 'l_suppkey')} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT n FROM reach))",
    )
    + f"SELECT {_R0} AS node, 0 AS depth, NULL AS predecessor UNION ALL SELECT {ek('Nation', 'n')}, 1, {_R0} FROM reach UNION ALL SELECT {ek('Supplier', 's_suppkey')}, 2, {ek('Nation', 's_nationkey')} FROM supplier WHERE s_nationkey IN (SELECT n FROM reach)"
    f" UNION ALL SELECT {ek('Customer', 'c_custkey')}, 2, {ek('Nation', 'c_nationkey')} FROM customer WHERE c_nationkey IN (SELECT n FROM reach) UNION ALL SELECT node, 3, min(p) FROM hops GROUP BY node",
)
def graph_bfs(spark, folder):
    """Inside, keys are the 32 bytes of their digests, which have the order of their texts."""
    start = node_parts(spark, folder)["Region"].filter("identity = '0'").select(F.unhex("key").alias("key"))
    used = edges(spark, folder, {"IN_REGION", "LOCATED_IN", "OWNED_BY", "DELIVERS"}).select(F.unhex("src").alias("src"), F.unhex("dst").alias("dst"))
    found = traverse.bfs(start, used, max_depth=3, directed=False)
    return found.select(F.lower(F.hex("node")).alias("node"), "depth", F.lower(F.hex("predecessor")).alias("predecessor"))


@query("graph_relation_path", "SELECT 'Part' AS source, 'Region' AS target, 'Part <-SUPPORTS- Supplier -LOCATED_IN-> Nation -IN_REGION-> Region' AS path, 3 AS steps WHERE EXISTS (SELECT 1 FROM lineitem)")
def graph_relation_path(spark, folder):
    """Relations between classes as the edges use them."""
    used = edges(spark, folder).select(F.col("src_class").alias("source"), "type", F.col("dst_class").alias("target")).distinct()
    return traverse.relation_path(used, "Part", "Region")


_USED = (
    "used AS (SELECT 'Nation' AS source, 'IN_REGION' AS type, 'Region' AS target, count(*) AS weight FROM nation UNION ALL SELECT 'Supplier', 'LOCATED_IN', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Customer', 'LOCATED_IN', 'Nation', count(*) FROM customer"
    " UNION ALL SELECT 'Order', 'OWNED_BY', 'Customer', count(*) FROM orders UNION ALL SELECT 'Supplier', 'DELIVERS', 'Order', count(DISTINCT (l_suppkey, l_orderkey)) FROM lineitem"
    " UNION ALL SELECT 'Supplier', CASE WHEN l_returnflag = 'R' THEN 'USES_PORTAL' ELSE 'SUPPORTS' END, 'Part', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem GROUP BY 2)",
    "onward AS (SELECT source, target, ' -' || type || '-> ' AS arrow, weight FROM used WHERE weight > 0)", "eitherway AS (FROM onward UNION ALL SELECT target, source, ' <-' || type || '- ', weight FROM used WHERE weight > 0)",
)


def _walks(name: str, hops: str) -> str:
    """All simple paths, of which the least by length and steps is kept per pair."""
    return (
        f"{name}_all AS (SELECT source, target, [arrow || target] AS steps_text, [source, target] AS been, weight FROM {hops} UNION ALL SELECT w.source, h.target, list_append(w.steps_text, h.arrow || h.target), list_append(w.been, h.target), least(w.weight, h.weight)"
        f" FROM {name}_all w JOIN {hops} h ON w.target = h.source WHERE NOT list_contains(w.been, h.target)), {name} AS (SELECT source, target, source || array_to_string(steps_text, '') AS path, CAST(len(steps_text) AS INTEGER) AS steps, weight FROM {name}_all"
        " QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY len(steps_text), steps_text) = 1)"
    )


@query(
    "graph_relation_paths",
    "WITH RECURSIVE " + ", ".join([*_USED, _walks("along", "onward"), _walks("around", "eitherway")])
    + " SELECT source, target, path, steps, TRUE AS directed, weight FROM along UNION ALL SELECT source, target, path, steps, FALSE, weight FROM around WHERE (source, target) NOT IN (SELECT (source, target) FROM along)",
)
def graph_relation_paths(spark, folder):
    """How any two classes of the vocabulary are related in the data, and how often the rarest relation on the way occurs."""
    used = edges(spark, folder).groupBy(F.col("src_class").alias("source"), "type", F.col("dst_class").alias("target")).agg(F.count("*").alias("weight"))
    return traverse.relation_paths(used)


def dated_edges(spark, folder):
    """Customers to orders for 120 days, orders to suppliers for 60 days from shipping, suppliers to nations at any time; under short keys."""
    day = lambda c, more=0: F.date_add(F.col(c).cast("date"), more)
    key = lambda cls, column: short_key(cls, F.col(column))
    edge = lambda df, kind, a, b, since, until, quantity: df.select(F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"), since.cast("date").alias("valid_from"), until.cast("date").alias("valid_to"), quantity.cast("double").alias("quantity"))
    none = F.lit(None)
    return union([
        edge(table(spark, folder, "orders"), "OWNS", key("Customer", "o_custkey"), key("Order", "o_orderkey"), day("o_orderdate"), day("o_orderdate", 120), none),
        edge(table(spark, folder, "lineitem"), "DELIVERED_BY", key("Order", "l_orderkey"), key("Supplier", "l_suppkey"), day("l_shipdate"), day("l_shipdate", 60), F.col("l_quantity")),
        edge(table(spark, folder, "supplier"), "LOCATED_IN", key("Supplier", "s_suppkey"), key("Nation", "s_nationkey"), none, none, none),
    ])


def _maximal(name: str, rows: str) -> str:
    return f"{name} AS (SELECT * FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {rows} y WHERE y.root = x.root AND y.node = x.node AND y.f <= x.f AND y.t >= x.t AND (y.f < x.f OR y.t > x.t)))"


@query(
    "graph_bfs_dated",
    with_sql(
        "held AS (SELECT DISTINCT o_custkey AS root, o_orderkey AS node, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 120 AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')", _maximal("one", "held"),
        "sent AS (SELECT DISTINCT l_orderkey, l_suppkey, CAST(l_shipdate AS DATE) AS f, CAST(l_shipdate AS DATE) + 60 AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 10 AND s_acctbal > 0)",
        "met AS (SELECT DISTINCT root, l_suppkey AS node, greatest(o.f, s.f) AS f, least(o.t, s.t) AS t FROM one o JOIN sent s ON o.node = s.l_orderkey WHERE greatest(o.f, s.f) <= least(o.t, s.t))", _maximal("two", "met"),
        "placed AS (SELECT DISTINCT root, s_nationkey AS node, f, t FROM two JOIN supplier ON node = s_suppkey)", _maximal("three", "placed"),
        f"found AS (SELECT {ek('Customer', 'c_custkey')} AS root, {ek('Customer', 'c_custkey')} AS node, 0 AS depth, NULL::DATE AS f, NULL::DATE AS t FROM customer UNION ALL SELECT {ek('Customer', 'root')}, {ek('Order', 'node')}, 1, f, t FROM one"
        f" UNION ALL SELECT {ek('Customer', 'root')}, {ek('Supplier', 'node')}, 2, f, t FROM two UNION ALL SELECT {ek('Customer', 'root')}, {ek('Nation', 'node')}, 3, f, t FROM three)",
    )
    + "SELECT root, node, depth, CAST(f AS VARCHAR) AS valid_from, CAST(t AS VARCHAR) AS valid_to FROM found",
)
def graph_bfs_dated(spark, folder):
    """Orders, suppliers in credit and nations that every customer reaches by large deliveries in effect together."""
    key = lambda cls, column: short_key(cls, F.col(column)).alias("key")
    allowed = union([
        orders(spark, folder).filter("o_orderstatus <> 'P'").select(key("Order", "o_orderkey")), table(spark, folder, "supplier").filter("s_acctbal > 0").select(key("Supplier", "s_suppkey")),
        table(spark, folder, "nation").select(key("Nation", "n_nationkey")),
    ])
    start = table(spark, folder, "customer").select(key("Customer", "c_custkey"))
    found = traverse.bfs_in_time(start, dated_edges(spark, folder), 3, node_filter=allowed, edge_filter=F.coalesce(F.col("quantity") >= 10, F.lit(True)))
    return found.withColumns({end: entity_key_of(NS, F.col(end)) for end in ("root", "node")})


def thread_graph(spark, folder):
    """Conversation turns linked in a chain, and orders linked to their customers."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    name = lambda t: F.concat_ws(":", F.lit("T"), F.col("conv_id").cast("string"), t.cast("string"))
    owned = table(spark, folder, "orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("dst"))
    following = turns.filter("turn > 0").select(name(F.col("turn") - 1).alias("src"), name(F.col("turn")).alias("dst"))
    keys = union([
        turns.select(name(F.col("turn")).alias("key")), owned.select(F.col("src").alias("key")), table(spark, folder, "customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("key")),
    ])
    return keys, owned.unionByName(following)


@query(
    "graph_components",
    "SELECT 'T:' || conv_id || ':' || turn AS key, min('T:' || conv_id || ':' || turn) OVER (PARTITION BY conv_id) AS component FROM conversations UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders UNION ALL SELECT 'C:' || c_custkey, 'C:' || c_custkey FROM customer",
)
def graph_components(spark, folder):
    return traverse.connected_components(*thread_graph(spark, folder))


# -------------------------------------------------------------------- evidence
def citations(spark, folder):
    """Contracts cite the document of their owner; pending ones cite nothing."""
    cited = F.col("o_orderstatus") != "P"
    return table(spark, folder, "orders").filter(cited).select(
        entity("Order", "o_orderkey").alias("subject_key"), entity("Document", "o_custkey").alias("document_key"), F.when(F.col("o_orderstatus") == "O", "synthetic:orders").otherwise("orders").alias("source_ref"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "approved").otherwise("unreviewed").alias("review_state"), F.lit("verified").alias("verification_state"),
    )


def cited(spark, folder):
    documents = table(spark, folder, "documents").select(entity("Document", "doc_id").alias("key"), F.col("doc_id").cast("string").alias("identity"))
    return build.evidence(node_parts(spark, folder)["Order"], citations(spark, folder), documents)


CITED = (
    f"cited AS (SELECT {ek('Order', 'o_orderkey')} AS subject_key, CASE WHEN o_orderstatus <> 'P' THEN {ek('Document', 'o_custkey')} END AS document_key, CASE o_orderstatus WHEN 'O' THEN 'synthetic:orders' WHEN 'F' THEN 'orders' END AS source_ref,"
    " CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'approved' ELSE 'unreviewed' END END AS review_state, CASE WHEN o_orderstatus <> 'P' THEN 'verified' END AS verification_state,"
    " CASE WHEN o_orderstatus <> 'P' THEN CAST(doc_id AS VARCHAR) END AS document_id FROM orders LEFT JOIN documents ON doc_id = o_custkey)"
)


@query("graph_evidence", with_sql(CITED) + "SELECT * FROM cited")
def graph_evidence(spark, folder):
    return cited(spark, folder)


@query(
    "evidence_quality",
    with_sql(CITED)
    + "SELECT subject_key, concat_ws(',', CASE WHEN document_key IS NULL THEN 'missing_provenance' END, CASE WHEN document_key IS NOT NULL AND document_id IS NULL THEN 'unresolved_document' END,"
    " CASE WHEN document_key IS NOT NULL AND review_state <> 'approved' THEN 'unverified_provenance' END, CASE WHEN contains(source_ref, 'synthetic') THEN 'synthetic_provenance' END) AS notes FROM cited",
)
def evidence_quality(spark, folder):
    return build.evidence_quality(cited(spark, folder)).withColumn("notes", F.array_join("notes", ","))


def cited_orders(spark, folder, short: bool = False):
    """Orders with the citations of their lines as nested values: repeated, unsorted, and some of them invalid."""
    line = table(spark, folder, "lineitem")
    second, quantity = F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int")
    text, none = F.lit(None).cast("string"), F.lit(None)
    fields = {
        "document_class": F.when(second, F.when(quantity == 50, "Part").otherwise("Document")), "document_id": F.when(second, F.col("l_suppkey").cast("string")),
        "page": F.when(second | (quantity == 49), F.col("l_linenumber") - F.when(quantity == 48, F.col("l_linenumber")).otherwise(0)).cast("bigint"), "section": F.when(second & (quantity == 47), " 4.1").otherwise(text), "chunk_id": text,
        "source_ref": F.when(quantity == 46, text).when(F.col("l_returnflag") == "A", "synthetic:lines").otherwise("lines"), "evidence_ref": text, "property_id": F.when(quantity == 45, "colour").when(quantity > 30, "total").otherwise(text),
        "review_state": F.when(quantity == 44, "seen").when(F.col("l_returnflag") == "N", "approved").otherwise("proposed"), "verification_state": F.lit("verified"), "extraction_run": text,
        "confidence": F.when(quantity == 43, F.lit(1.5)).when(quantity > 20, F.col("l_discount")).otherwise(none.cast("double")),
    }
    citation = F.struct(*[v.alias(k) for k, v in fields.items()])
    grouped = line.groupBy("l_orderkey").agg(F.collect_list(citation).alias("once"))
    key = short_key("Order", F.col("l_orderkey")) if short else entity("Order", "l_orderkey")
    return grouped.select(key.alias("subject_key"), F.concat("once", F.reverse("once")).alias("citations"))


def checked_orders(spark, folder, short: bool = False):
    properties = [p.id for p in VOCABULARY.properties_of("Order")]
    return evidence.checked(cited_orders(spark, folder, short), properties, ["Document"])


_CITATION_SQL = (
    "raw AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS second, CAST(l_quantity AS INTEGER) AS q, l_suppkey, l_returnflag, l_discount FROM lineitem)",
    f"made AS (SELECT {ek('Order', 'l_orderkey')} AS subject_key, CASE WHEN second THEN CASE WHEN q = 50 THEN 'Part' ELSE 'Document' END END AS document_class, CASE WHEN second THEN CAST(l_suppkey AS VARCHAR) END AS document_id,"
    " CASE WHEN second OR q = 49 THEN CAST(l_linenumber - CASE WHEN q = 48 THEN l_linenumber ELSE 0 END AS BIGINT) END AS page, CASE WHEN second AND q = 47 THEN ' 4.1' END AS section,"
    " CASE WHEN q = 46 THEN NULL WHEN l_returnflag = 'A' THEN 'synthetic:lines' ELSE 'lines' END AS source_ref, CASE WHEN q = 45 THEN 'colour' WHEN q > 30 THEN 'total' END AS property_id,"
    " CASE WHEN q = 44 THEN 'seen' WHEN l_returnflag = 'N' THEN 'approved' ELSE 'proposed' END AS review_state, CASE WHEN q = 43 THEN 1.5 WHEN q > 20 THEN l_discount END AS confidence FROM raw)",
    "faults AS (SELECT subject_key, unnest(list_filter([CASE WHEN review_state = 'seen' THEN 'review_state' END, CASE WHEN property_id = 'colour' THEN 'property' END, CASE WHEN section LIKE ' %' THEN 'text' END, CASE WHEN page < 1 THEN 'page' END, CASE WHEN confidence > 1 THEN 'confidence' END,"
    " CASE WHEN document_class = 'Part' THEN 'document_class' END, CASE WHEN document_id IS NULL AND page IS NOT NULL THEN 'location_without_document' END, CASE WHEN document_id IS NULL AND source_ref IS NULL THEN 'nothing_cited' END], lambda x: x IS NOT NULL)) AS code FROM made)",
    "stored AS (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY document_class NULLS FIRST, document_id NULLS FIRST, page NULLS FIRST, section NULLS FIRST, source_ref NULLS FIRST, property_id NULLS FIRST, review_state, confidence NULLS FIRST) AS position,"
    f" CASE WHEN document_id IS NOT NULL THEN {ek('Document', 'document_id')} END AS document_key FROM (SELECT DISTINCT * FROM made) WHERE subject_key NOT IN (SELECT subject_key FROM faults))",
)


@query("citation_violations", with_sql(*_CITATION_SQL) + "SELECT subject_key, code, 2 * count(*) AS citations FROM faults GROUP BY ALL")
def citation_violations(spark, folder):
    """How often each rule is broken by the citations of a record, as they came (every one twice)."""
    rows = checked_orders(spark, folder).select("subject_key", F.explode("violations").alias("v"))
    return rows.groupBy("subject_key", F.col("v.code").alias("code")).agg(F.count("*").alias("citations"))


@query("citation_canonical", with_sql(*_CITATION_SQL) + "SELECT subject_key, CAST(position AS INTEGER) AS position, document_key, page, source_ref, property_id, review_state, confidence FROM stored")
def citation_canonical(spark, folder):
    rows = evidence.listed(checked_orders(spark, folder), NS)
    return rows.select("subject_key", "position", "document_key", "page", "source_ref", "property_id", "review_state", "confidence")


EVIDENCE_LIMIT = 2


def evidence_parts(spark, folder):
    """Orders and deliveries with their citations, documents and EVIDENCED_BY edges, under short keys; customers are asked for in vain."""
    known, delivered = node_parts(spark, folder, short=True)["Order"], edges(spark, folder, {"DELIVERS"}, short=True)
    cited = evidence.listed(checked_orders(spark, folder, short=True), NS, short=True)
    node = lambda cls, column: short_key(cls, F.col(column))
    lines = table(spark, folder, "lineitem")
    delivery = short_relationship_key("DELIVERS", node("Supplier", "l_suppkey"), node("Order", "l_orderkey"))
    of_edges = lines.select(delivery.alias("subject_key"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("position"), node("Document", "l_partkey").alias("document_key")).distinct()
    documents = table(spark, folder, "documents").select(node("Document", "doc_id").alias("key"))
    proven = walked_short(build.map_edges(lines, "EVIDENCED_BY", "Order", "Document", "l_orderkey", "l_partkey", NS, short=True))
    asked = union([known.select(F.lit("node").alias("kind"), "key"), delivered.select(F.lit("edge").alias("kind"), "key"), table(spark, folder, "customer").select(F.lit("node").alias("kind"), node("Customer", "c_custkey").alias("key"))])
    citations = cited.select("subject_key", F.col("position").cast("bigint").alias("position"), "document_key").unionByName(of_edges)
    return asked, known, delivered, citations, documents, proven


_EVIDENCE_SQL = (
    *_CITATION_SQL,
    f"deliveries AS (SELECT {rk('DELIVERS', 'src', 'dst')} AS key, l_partkey, l_linenumber FROM (SELECT *, {ek('Supplier', 'l_suppkey')} AS src, {ek('Order', 'l_orderkey')} AS dst FROM lineitem))",
    f"known AS (SELECT 'node' AS kind, {ek('Order', 'o_orderkey')} AS key FROM orders UNION ALL SELECT DISTINCT 'edge', key FROM deliveries)",
    f"cites AS (SELECT 'node' AS kind, subject_key, position, document_key FROM stored SEMI JOIN known ON key = subject_key UNION ALL SELECT DISTINCT 'edge', key, l_partkey * 8 + l_linenumber, {ek('Document', 'l_partkey')} FROM deliveries)",
    "first_cites AS (SELECT *, count(*) OVER (PARTITION BY kind, subject_key) > 2 AS truncated FROM cites QUALIFY row_number() OVER (PARTITION BY kind, subject_key ORDER BY position) <= 2)",
    f"found_docs AS (SELECT DISTINCT kind, subject_key, document_key FROM first_cites WHERE document_key IN (SELECT {ek('Document', 'doc_id')} FROM documents))",
    f"proofs AS (SELECT DISTINCT {ek('Order', 'l_orderkey')} AS subject_key, {ek('Document', 'l_partkey')} AS item_key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))",
)


@query(
    "graph_evidence_subjects",
    with_sql(*_EVIDENCE_SQL)
    + "SELECT kind, key AS subject_key, 'subject' AS part, 1 AS position, key AS item_key, FALSE AS truncated FROM known"
    f" UNION ALL SELECT 'node', {ek('Customer', 'c_custkey')}, 'subject', 1, NULL, FALSE FROM customer"
    " UNION ALL SELECT kind, subject_key, 'citation', CAST(position AS INTEGER), document_key, truncated FROM first_cites"
    " UNION ALL SELECT kind, subject_key, 'document', CAST(row_number() OVER (PARTITION BY kind, subject_key ORDER BY document_key) AS INTEGER), document_key, FALSE FROM found_docs"
    " UNION ALL SELECT 'node', subject_key, 'evidenced_by', CAST(r AS INTEGER), item_key, n > 2 FROM (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY item_key) AS r, count(*) OVER (PARTITION BY subject_key) AS n FROM proofs) WHERE r <= 2",
)
def graph_evidence_subjects(spark, folder):
    found = evidence.lookup(*evidence_parts(spark, folder), EVIDENCE_LIMIT, lambda k: order_of(NS, k))
    # The item of a subject's own row is the subject; other items are documents.
    edge = F.col("kind") == "edge"
    found = with_canonical(found, NS, "item_key", edge & (F.col("part") == "subject"))
    return with_canonical(found, NS, "subject_key", edge)


@query(
    "evidence_quality_bounded",
    with_sql(CITED, "lines AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
    + f"SELECT {ek('Order', 'l_orderkey')} AS subject_key, concat_ws(',', CASE WHEN bool_or(l_returnflag = 'A') THEN 'synthetic_provenance' END, CASE WHEN max(n) > 2 THEN 'truncated' END) AS notes FROM lines WHERE r <= 2 GROUP BY l_orderkey",
)
def evidence_quality_bounded(spark, folder):
    """Notes from at most two citations per order, which then say that there are more."""
    cited = table(spark, folder, "lineitem").select(
        entity("Order", "l_orderkey").alias("subject_key"), F.lit(None).cast("string").alias("document_key"), F.lit(None).cast("string").alias("document_id"), F.when(F.col("l_returnflag") == "A", "synthetic:lines").otherwise("lines").alias("source_ref"),
        F.lit("approved").alias("review_state"), F.lit("verified").alias("verification_state"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
    )
    first = ranking.first_per_root(cited, ["subject_key"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], 2)
    return build.evidence_quality(first).withColumn("notes", F.array_join("notes", ","))


@query(
    "bounded_truncated",
    "SELECT o_custkey, o_orderkey, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 5",
)
def bounded_truncated(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.first_per_root(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).drop("o_orderdate")


# --------------------------------------------------------------------- audits
def lines(spark, folder):
    return table(spark, folder, "lineitem")


def parts(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")


def links(spark, folder):
    """Vendor to contract links."""
    return lines(spark, folder).select(F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("contract_id")).distinct()


_LINKS = "links AS (SELECT DISTINCT l_suppkey AS vendor_id, l_orderkey AS contract_id FROM lineitem)"


@query("graph_audit_clauses", with_sql(CONTRACTS, CLAUSES, _LINKS) + "SELECT l.vendor_id, l.contract_id, class_id AS clause_class, identity AS occurrence_id FROM links l JOIN clauses ON contract_identity = CAST(l.contract_id AS VARCHAR)")
def audit_clauses(spark, folder):
    terms = clauses(spark, folder).select(F.col("contract_identity").cast("long").alias("contract_id"), F.col("class_id").alias("clause_class"), F.col("identity").alias("occurrence_id"))
    return links(spark, folder).join(terms, "contract_id")


@query("graph_audit_clause_evidence", with_sql(CONTRACTS, CLAUSES) + "SELECT c.contract_id, class_id AS clause_class, doc_id AS document_id FROM contracts c JOIN clauses ON contract_identity = CAST(c.contract_id AS VARCHAR) JOIN documents ON doc_id = c.vendor_id")
def audit_clause_evidence(spark, folder):
    terms = clauses(spark, folder).select(F.col("contract_identity").cast("long").alias("contract_id"), F.col("class_id").alias("clause_class"))
    owned = contracts(spark, folder).select("contract_id", F.col("vendor_id").alias("document_id"))
    known = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"))
    return owned.join(terms, "contract_id").join(known, "document_id", "left_semi").select("contract_id", "clause_class", "document_id")


def applications(spark, folder, condition):
    used = lines(spark, folder).filter(condition).select(F.col("l_suppkey").alias("vendor_id"), "l_partkey").distinct()
    criticality = F.when(F.col("p_size") >= 45, "Critical").otherwise("Normal")
    return used.join(parts(spark, folder), "l_partkey").select("vendor_id", F.col("l_partkey").alias("application_id"), criticality.alias("criticality"))


def _applications_sql(condition):
    return f"SELECT DISTINCT l_suppkey AS vendor_id, l_partkey AS application_id, CASE WHEN p_size >= 45 THEN 'Critical' ELSE 'Normal' END AS criticality FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {condition}"


@query("graph_audit_supports", _applications_sql("l_returnflag <> 'R'"))
def audit_supports(spark, folder):
    return applications(spark, folder, "l_returnflag <> 'R'")


@query("graph_audit_portals", _applications_sql("l_returnflag = 'R'"))
def audit_portals(spark, folder):
    return applications(spark, folder, "l_returnflag = 'R'")


@query("graph_audit_cost_centers", "SELECT l_orderkey AS contract_id, l_linenumber AS line_number, p_brand AS cost_center FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def audit_cost_centers(spark, folder):
    billed = lines(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey")
    known = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return billed.join(parts(spark, folder), "l_partkey").join(known, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line_number"), F.col("p_brand").alias("cost_center"))


@query(
    "graph_audit_breach_source",
    with_sql(MEASUREMENTS, q_risk.MEASURED, _LINKS) + "SELECT l.contract_id, m.vendor_id, CAST(m.actual AS VARCHAR) AS actual, d.doc_id AS document_id FROM links l JOIN measured m USING (vendor_id) JOIN documents d ON d.doc_id = m.vendor_id WHERE m.breach AND m.period = '2024-01-15'",
)
def audit_breach_source(spark, folder):
    breached = q_risk.measured(spark, folder).filter((F.col("period") == "2024-01-15") & F.col("breach")).select("vendor_id", "actual")
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("vendor_id"), F.col("doc_id").alias("document_id"))
    return links(spark, folder).join(breached.join(sources, "vendor_id"), "vendor_id").select("contract_id", "vendor_id", "actual", "document_id")


@query(
    "graph_audit_open_findings",
    "SELECT DISTINCT l_suppkey AS vendor_id, 'RA-' || doc_id AS assessment_id, o_orderkey AS issue_id, l_partkey AS application_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN documents ON doc_id = l_suppkey WHERE o_orderstatus = 'O' AND p_size >= 45",
)
def audit_open_findings(spark, folder):
    critical = parts(spark, folder).filter("p_size >= 45").select("l_partkey")
    open_orders = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    affected = lines(spark, folder).select("l_suppkey", "l_orderkey", "l_partkey").join(critical, "l_partkey", "left_semi").join(open_orders, "l_orderkey", "left_semi").distinct()
    assessed = assessments(spark, folder).select(F.col("vendor_id").alias("l_suppkey"), "assessment_id")
    return affected.join(assessed, "l_suppkey").select(F.col("l_suppkey").alias("vendor_id"), "assessment_id", F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("application_id"))


@query("graph_audit_products", "SELECT DISTINCT l_suppkey AS vendor_id, p_brand AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'")
def audit_products(spark, folder):
    used = lines(spark, folder).filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("vendor_id"), "l_partkey").distinct()
    return used.join(parts(spark, folder), "l_partkey").select("vendor_id", F.col("p_brand").alias("product_id")).distinct()
