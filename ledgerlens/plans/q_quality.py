"""Data-quality reports over the test tables: one row per violation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import quality, risk
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import BRIDGE, bridge, dec, table, with_sql


@query(
    "conformance_violations",
    "WITH f AS (SELECT l.l_orderkey, l.l_linenumber, l.l_linestatus, l.l_shipdate, o.* FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') o ON l.l_orderkey = o.o_orderkey)"
    " SELECT 'missing_master' AS rule, 'lineitem' AS table_name, l_orderkey || '|' || l_linenumber AS record_key, CAST(l_orderkey AS VARCHAR) AS detail FROM f WHERE o_orderkey IS NULL"
    " UNION ALL SELECT 'mismatch_l_linestatus', 'lineitem', l_orderkey || '|' || l_linenumber, l_linestatus || ' <> ' || o_orderstatus FROM f WHERE o_orderkey IS NOT NULL AND l_linestatus <> o_orderstatus",
)
def conformance_violations(spark, folder):
    """Lines must meet an order that is not of low priority and agree with its status."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    master = table(spark, folder, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return quality.conformance_violations(lines, master, "lineitem", "l_orderkey", ["l_orderkey", "l_linenumber"], {"l_linestatus": "o_orderstatus"})


@query(
    "orphans_anti",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')",
)
def orphans_anti(spark, folder):
    """Lines whose order is not among the closed ones."""
    closed = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return quality.orphans(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), closed, {"l_orderkey": "o_orderkey"})


@query(
    "keyset_coverage",
    "SELECT coalesce(a.vendor_id, b.vendor_id) AS vendor_id, CASE WHEN b.vendor_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT s_suppkey AS vendor_id FROM supplier) a"
    " FULL OUTER JOIN (SELECT DISTINCT user_id AS vendor_id FROM events) b ON a.vendor_id = b.vendor_id WHERE a.vendor_id IS NULL OR b.vendor_id IS NULL",
)
def keyset_coverage(spark, folder):
    masters = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"))
    return quality.keyset_coverage(masters, table(spark, folder, "events").select(F.col("user_id").alias("vendor_id")), ["vendor_id"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return quality.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dedupe_conflicts",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count, count(DISTINCT (l_partkey, l_suppkey, l_returnflag, l_linestatus)) > 1 AS conflict FROM lineitem GROUP BY 1, 2",
)
def dedupe_conflicts(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return quality.dedupe_conflicts(lines, ["l_orderkey", "l_linenumber"])


@query(
    "dq_patterns",
    "SELECT 'brand_pattern' AS rule, 'part' AS table_name, CAST(p_partkey AS VARCHAR) AS record_key, 'p_brand=' || p_brand AS detail FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#\\d{2}')"
    " UNION ALL SELECT 'type_pattern', 'part', CAST(p_partkey AS VARCHAR), 'p_type=' || p_type FROM part WHERE NOT regexp_full_match(p_type, '[A-Z]{5,7}')",
)
def dq_patterns(spark, folder):
    rules = {"brand_pattern": quality.pattern_rule("p_brand", r"Brand#\d{2}"), "type_pattern": quality.pattern_rule("p_type", "[A-Z]{5,7}")}
    return quality.row_rules(table(spark, folder, "part"), "part", ["p_partkey"], rules)


@query(
    "dq_intervals",
    "SELECT 'ordered_interval' AS rule, 'lineitem' AS table_name, l_orderkey || '|' || l_linenumber AS record_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' > ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS detail"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE)",
)
def dq_intervals(spark, folder):
    """The contract must not end before it starts: order date against ship date."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("end_date"))
    starts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("start_date"))
    return quality.row_rules(lines.join(starts, "l_orderkey"), "lineitem", ["l_orderkey", "l_linenumber"], {"ordered_interval": quality.interval_rule("start_date", "end_date")})


@query(
    "dq_single_snapshot",
    "SELECT 'single_snapshot' AS rule, 'orders' AS table_name, 'o_orderdate' AS record_key, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) || ' .. ' || max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS detail FROM orders HAVING min(o_orderdate) <> max(o_orderdate)"
    " UNION ALL SELECT 'single_snapshot', 'lineitem', 'l_shipdate', min(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) || ' .. ' || max(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) FROM lineitem HAVING min(l_shipdate) <> max(l_shipdate)",
)
def dq_single_snapshot(spark, folder):
    parts = [
        quality.single_value(table(spark, folder, name).select(F.col(column).cast("date").alias(column)), name, column)
        for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return quality.report(*parts)


@query(
    "dq_enums",
    "SELECT 'event_type_enum' AS rule, 'events' AS table_name, CAST(event_id AS VARCHAR) AS record_key, 'event_type=' || event_type AS detail FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')",
)
def dq_enums(spark, folder):
    rules = {"event_type_enum": quality.enum_rule("event_type", ["click", "view", "purchase", "signup"])}
    return quality.row_rules(table(spark, folder, "events"), "events", ["event_id"], rules)


@query(
    "dq_missing_risk",
    "SELECT 'missing_carries_tier' AS rule, 'assessments' AS table_name, CAST(d.doc_id AS VARCHAR) AS record_key, d.lang || ',' || d.source AS detail FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND d.lang <> 'en'",
)
def dq_missing_risk(spark, folder):
    """Unlabelled documents are Missing assessments; a language other than English stands for a tier they must not carry."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality").isNull(), "Missing").otherwise("Current").alias("status"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("tier"), F.when(F.col("lang") != "en", F.col("source")).alias("assessed_on"),
    )
    return quality.row_rules(rows, "assessments", ["doc_id"], {"missing_carries_tier": quality.missing_status_rule("status", ["tier", "assessed_on"])})


@query(
    "dq_nonneg",
    "SELECT 'nonnegative' AS rule, 'supplier' AS table_name, CAST(s_suppkey AS VARCHAR) AS record_key, 'balance' AS detail FROM supplier WHERE s_acctbal < 0"
    " UNION ALL SELECT 'nonnegative', 'customer', CAST(c_custkey AS VARCHAR), 'balance' FROM customer WHERE c_acctbal < 0",
)
def dq_nonneg(spark, folder):
    parts = [
        quality.row_rules(table(spark, folder, name).select(key, dec(value).alias("balance")), name, [key], {"nonnegative": quality.nonnegative_rule(["balance"])})
        for name, key, value in (("supplier", "s_suppkey", "s_acctbal"), ("customer", "c_custkey", "c_acctbal"))
    ]
    return quality.report(*parts)


PART_PROPERTIES = {
    "part_id": {"datatype": "identifier", "required": True, "pattern": "[0-9]+", "synonyms": ["p_partkey"]},
    "name": {"datatype": "string", "required": True, "pattern": "[a-z]+ [a-z]+", "synonyms": ["p_name"]},
    "kind": {"datatype": "string", "enum": ["STANDARD", "ECONOMY", "PROMO", "SMALL", "LARGE"], "synonyms": ["p_type"]},
    "fill_percent": {"datatype": "percentage", "synonyms": ["fill"]},
    "size": {"datatype": "integer", "synonyms": ["p_size"]},
    "last_checked": {"datatype": "date", "required": True},
}


@query(
    "record_validation",
    "WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, * FROM part)"
    " SELECT 'Part' AS class_id, k AS record_key, 'p_type' AS field, 'value_not_allowed' AS error FROM p WHERE p_type = 'MEDIUM'"
    " UNION ALL SELECT 'Part', k, 'fill', 'out_of_range' FROM p WHERE p_size * 3 > 100"
    " UNION ALL SELECT 'Part', k, 'p_brand', 'unknown_field' FROM p"
    " UNION ALL SELECT 'Part', k, 'last_checked', 'missing_field' FROM p",
)
def record_validation(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_size", (F.col("p_size") * 3).alias("fill"), "p_brand")
    return quality.record_validation(parts, "Part", ["p_partkey"], PART_PROPERTIES)


# ------------------------------------------------------------- source against source
@query(
    "bridge_mismatch",
    with_sql(
        BRIDGE, "g AS (SELECT DISTINCT l_suppkey AS vendor_id, l_partkey AS application_id, CASE WHEN l_returnflag = 'A' THEN 'USES_PORTAL' ELSE 'SUPPORTS' END AS relation FROM lineitem)",
        "a AS (SELECT * FROM g EXCEPT SELECT * FROM bridge)", "b AS (SELECT * FROM bridge EXCEPT SELECT * FROM g)",
    )
    + "SELECT *, 'graph_only' AS side FROM a UNION ALL SELECT *, 'structured_only' FROM b",
)
def bridge_mismatch(spark, folder):
    """The structured bridge against a second reading of the same lines with another relation rule."""
    relation = F.when(F.col("l_returnflag") == "A", "USES_PORTAL").otherwise("SUPPORTS")
    graph = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("application_id"), relation.alias("relation"))
    return risk.bridge_mismatch(graph, bridge(spark, folder), ["vendor_id", "application_id", "relation"])


@query(
    "contradictions",
    "WITH o AS (SELECT DISTINCT l_orderkey AS contract_id, 'Contract.status' AS concept, l_linestatus AS observed_value FROM lineitem),"
    " d AS (SELECT DISTINCT l_orderkey AS contract_id, 'Contract.end_date' AS concept, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS observed_value FROM lineitem),"
    " c AS (SELECT o_orderkey AS contract_id, 'Contract.status' AS concept, o_orderstatus AS certified_value FROM orders UNION ALL SELECT o_orderkey, 'Contract.end_date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders)"
    " SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM d) x JOIN c USING (contract_id, concept) WHERE observed_value <> certified_value",
)
def contradictions(spark, folder):
    observed = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").cast("date").alias("end_date"))
    certified = table(spark, folder, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("end_date"))
    return risk.contradictions(observed, certified, "contract_id", {"status": "Contract.status", "end_date": "Contract.end_date"})


@query(
    "semi_exists",
    "SELECT vendor_id, CAST(CAST(round(sum(actual), 2) AS DECIMAL(18,2)) AS VARCHAR) AS actual, count(*) AS line_count FROM (SELECT l_suppkey AS vendor_id, l_partkey,"
    " CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS actual FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R'))"
    " GROUP BY 1",
)
def semi_exists(spark, folder):
    """Spend on applications the vendor also uses as a portal: the bridge filters and never multiplies money."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("application_id"), (dec("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - dec("l_discount", 4))).cast("decimal(18,6)").alias("actual")
    )
    portals = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("application_id")).distinct()
    kept = lines.join(portals, ["vendor_id", "application_id"], "left_semi")
    return kept.groupBy("vendor_id").agg(F.round(F.sum("actual"), 2).cast("decimal(18,2)").alias("actual"), F.count("*").alias("line_count"))
