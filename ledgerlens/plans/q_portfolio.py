"""Composite queries: vendor view, renewals, overlap and the contract dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.money import cents
from ledgerlens.operators import contracts as contract_ops
from ledgerlens.operators import dashboard, overlap, risk, spend, vendor360
from ledgerlens.plans import q_risk, q_spend
from ledgerlens.plans.q_contracts import ATTENTION_SQL
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import (
    AS_OF,
    ASSESSMENTS,
    BRIDGE,
    CONTRACTS,
    MEASUREMENTS,
    RENEWAL_TERMS,
    VENDORS,
    assessments,
    bridge,
    cents_sql,
    contracts,
    links,
    money_sql,
    percent_sql,
    renewal_terms,
    spend_lines,
    spend_lines_sql,
    table,
    vendors,
    with_sql,
)
from ledgerlens.session import in_parts

# ------------------------------------------------------------------ vendor view


def vendor_contracts(spark, folder):
    """Per vendor: contract interval, distinct owners served (assignments) and open orders (issues).

    Lines meet their order first, in parts of bounded size; the grouping by vendor and order then needs no further
    shuffle. One row per vendor and order, then per vendor and owner, turns every distinct count into a plain count.
    """
    lines = in_parts(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    per_order = lines.join(orders, "o_orderkey").groupBy("o_orderkey", "vendor_id", "o_custkey", "o_orderstatus").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    per_owner = per_order.groupBy("vendor_id", "o_custkey").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(F.col("o_orderstatus") == "O").alias("open")
    )
    return per_owner.groupBy("vendor_id").agg(
        F.min("first").cast("date").alias("start_date"), F.max("last").cast("date").alias("end_date"), F.count("*").alias("assignment_count"), F.sum("open").alias("open_issue_count")
    )


def view(spark, folder):
    finance = q_spend.finance(spark, folder).select("vendor_id", "budget", "forecast", "actual_ytd", "forecast_variance_amount", "forecast_variance_pct", "actual_ytd_variance_amount", "actual_ytd_variance_pct")
    # Links are counted per vendor and application anyway, so they need not be distinct first.
    dependencies = risk.dependency_counts(in_parts(links(spark, folder), "vendor_id", "application_id"))
    sections = [
        vendor_contracts(spark, folder), finance, dependencies, risk.breach_rollup(q_risk.measured(spark, folder)), risk.status_rollup(assessments(spark, folder), ["vendor_id"]),
    ]
    return vendor360.vendor_360(vendors(spark, folder), sections, AS_OF)


VIEW = [
    VENDORS, *q_spend.RECORDS_SQL, q_spend.FINANCE_SQL, BRIDGE, q_risk.DEPENDENCY_COUNTS, MEASUREMENTS, q_risk.MEASURED, ASSESSMENTS,
    "linked AS (SELECT l_suppkey AS vendor_id, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date, count(DISTINCT o_custkey) AS assignment_count,"
    " count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS open_issue_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)",
    "sla AS (SELECT vendor_id, CASE WHEN count(*) FILTER (breach) > 0 THEN TRUE WHEN count(*) FILTER (breach IS NULL) = 0 THEN FALSE END AS has_breach, count(*) FILTER (breach) AS breached_measurements, count(*) AS measurement_count FROM measured GROUP BY 1)",
    "risks AS (SELECT vendor_id, CASE WHEN min(status) = max(status) THEN min(status) END AS risk_status, count(*) AS assessment_count, bool_or(status = 'Stale') AS has_stale, bool_or(status = 'Missing') AS has_missing FROM assessments GROUP BY 1)",
    f"joined AS (SELECT v.*, start_date, end_date, budget, forecast, actual_ytd, forecast - budget AS forecast_variance_amount, {percent_sql('(forecast - budget)', 'budget')} AS forecast_variance_pct,"
    f" actual_ytd - comparable_ytd_budget AS actual_ytd_variance_amount, {percent_sql('(actual_ytd - comparable_ytd_budget)', 'comparable_ytd_budget')} AS actual_ytd_variance_pct,"
    " assignment_count, open_issue_count, application_count, supported_application_count, used_portal_count, has_breach, breached_measurements, measurement_count, risk_status, assessment_count, has_stale, has_missing,"
    f" end_date - DATE '{AS_OF}' AS days_to_expiry FROM vendors v LEFT JOIN linked USING (vendor_id) LEFT JOIN finance USING (vendor_id) LEFT JOIN dependency_counts USING (vendor_id) LEFT JOIN sla USING (vendor_id) LEFT JOIN risks USING (vendor_id))",
    "gapped AS (SELECT *, concat_ws(',', CASE WHEN application_count IS NULL THEN 'graph_unavailable' END, CASE WHEN budget IS NULL OR forecast IS NULL OR actual_ytd IS NULL THEN 'missing_scenario' END,"
    " CASE WHEN coalesce(assignment_count, 0) = 0 THEN 'missing_workforce' END, CASE WHEN coalesce(has_missing, FALSE) THEN 'risk_missing' END, CASE WHEN assessment_count IS NULL THEN 'risk_unavailable' END,"
    " CASE WHEN measurement_count IS NULL THEN 'sla_unavailable' END, CASE WHEN measurement_count IS NOT NULL AND has_breach IS NULL THEN 'sla_unknown' END) AS gap_codes FROM joined)",
    "v360 AS (SELECT *, CASE WHEN gap_codes <> '' THEN 'incomplete' ELSE 'no_reported_gaps' END AS retrieval_status FROM gapped)",
]
_MONEY = ("budget", "forecast", "actual_ytd", "forecast_variance_amount", "forecast_variance_pct", "actual_ytd_variance_amount", "actual_ytd_variance_pct")


@query(
    "vendor_360",
    with_sql(*VIEW) + "SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, " + ", ".join(f"CAST(CAST({m} AS DECIMAL(18,2)) AS VARCHAR) AS {m}" for m in _MONEY) + ") FROM v360",
)
def vendor_360(spark, folder):
    return view(spark, folder).withColumn("gap_codes", F.array_join("gap_codes", ","))


@query(
    "dependency_risk",
    with_sql(*VIEW) + "SELECT vendor_id, vendor_name, application_count, supported_application_count, used_portal_count, assignment_count, has_breach, breached_measurements, risk_status, open_issue_count, retrieval_status FROM v360",
)
def dependency_risk(spark, folder):
    return view(spark, folder).select(
        "vendor_id", "vendor_name", "application_count", "supported_application_count", "used_portal_count", "assignment_count", "has_breach", "breached_measurements", "risk_status", "open_issue_count", "retrieval_status"
    )


def _flags_sql(days: int) -> str:
    cases = [
        ("EXPIRING_SOON", f"days_to_expiry BETWEEN 0 AND {days}", "CAST(days_to_expiry AS VARCHAR)"),
        ("HIGH_FORECAST_VARIANCE", "forecast_variance_pct > -1.05", "CAST(CAST(forecast_variance_pct AS DECIMAL(18,2)) AS VARCHAR)"),
        ("HIGH_DEPENDENCY", "application_count >= 525", "CAST(application_count AS VARCHAR)"),
        ("SLA_BREACH", "has_breach", "'true'"), ("STALE_RISK", "has_stale", "'Stale'"), ("MISSING_RISK", "has_missing", "'Missing'"),
        ("INCOMPLETE_EVIDENCE", "retrieval_status = 'incomplete'", "gap_codes"),
    ]
    return " UNION ALL ".join(f"SELECT vendor_id, CAST(end_date AS VARCHAR) AS end_date, '{code}' AS flag, {seen} AS observed FROM {{source}} WHERE {test}" for code, test, seen in cases)


@query("renewal_flags", with_sql(*VIEW) + _flags_sql(150).format(source="v360"))
def renewal_flags(spark, folder):
    return vendor360.renewal_flags(view(spark, folder), 150, "-1.05", 525)


@query("renewal_priorities", with_sql(*VIEW, "near AS (SELECT * FROM v360 WHERE days_to_expiry BETWEEN 0 AND 151)") + _flags_sql(151).format(source="near"))
def renewal_priorities(spark, folder):
    return vendor360.renewal_priorities(view(spark, folder), 151, "-1.05", 525)


@query(
    "evidence_status",
    "WITH codes AS (SELECT DISTINCT user_id AS vendor_id, CASE event_type WHEN 'error' THEN 'truncated_graph' WHEN 'signup' THEN 'synthetic_data' WHEN 'view' THEN CASE WHEN value > 60 THEN 'sla_unknown' ELSE 'read_consistency' END ELSE 'financial_periods' END AS code FROM events)"
    " SELECT vendor_id, coalesce(string_agg(CASE WHEN code IN ('truncated_graph', 'sla_unknown') THEN code END, ',' ORDER BY code), '') AS gap_codes,"
    " CASE WHEN count(*) FILTER (code IN ('truncated_graph', 'sla_unknown')) > 0 THEN 'incomplete' ELSE 'no_reported_gaps' END AS retrieval_status FROM codes GROUP BY 1",
)
def evidence_status(spark, folder):
    """Event types stand for limitation codes."""
    code = (
        F.when(F.col("event_type") == "error", "truncated_graph").when(F.col("event_type") == "signup", "synthetic_data")
        .when(F.col("event_type") == "view", F.when(F.col("value") > 60, "sla_unknown").otherwise("read_consistency")).otherwise("financial_periods")
    )
    limitations = table(spark, folder, "events").select(F.col("user_id").alias("vendor_id"), code.alias("code"))
    return vendor360.evidence_status(limitations).withColumn("gap_codes", F.array_join("gap_codes", ","))


# ---------------------------------------------------------------------- overlap
VENDOR = 7


def keys(spark, folder):
    """Distinct keys of every vendor. Its parts are its applications, whether or not a part is described; brands and types are read from parts.

    Lines are dealt by part once, in parts of bounded size, for both.
    """
    lines = in_parts(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), "l_partkey"), "l_partkey")
    organizations = vendors(spark, folder).select("vendor_id", "organization_id")
    used = lines.distinct()
    described = used.join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").join(organizations, "vendor_id")
    applications = used.filter("l_partkey IS NOT NULL").join(organizations, "vendor_id").select("vendor_id", "organization_id", F.lit("application").alias("kind"), F.col("l_partkey").cast("string").alias("key"))
    return applications.unionByName(overlap.vendor_keys(described, {"product": "p_brand", "service": "p_type"}, keep=["organization_id"]))


def pair_context(spark, folder):
    """One row per vendor: finances, contract end, assignments and application relations."""
    finance = q_spend.finance(spark, folder).select("vendor_id", "forecast", "budget")
    terms = vendor_contracts(spark, folder).select("vendor_id", F.col("end_date").cast("string").alias("end_date"), "assignment_count")
    return finance.join(terms, "vendor_id", "full_outer").join(overlap.application_relations(bridge(spark, folder)), "vendor_id", "full_outer")


KEYS = (
    "keys AS (SELECT l_suppkey AS vendor_id, s_nationkey AS organization_id, kind, key FROM (SELECT DISTINCT l_suppkey, 'application' AS kind, CAST(l_partkey AS VARCHAR) AS key FROM lineitem"
    " UNION ALL SELECT DISTINCT l_suppkey, 'product', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey"
    " UNION ALL SELECT DISTINCT l_suppkey, 'service', p_type FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN supplier ON l_suppkey = s_suppkey)"
)
GROUPS = "groups AS (SELECT kind, key, count(*) AS vendor_count, count(*) * (count(*) - 1) // 2 AS pair_count FROM keys GROUP BY 1, 2 HAVING count(*) > 1)"
CONTEXT = [
    *q_spend.RECORDS_SQL,
    q_spend.FINANCE_SQL,
    BRIDGE,
    "terms AS (SELECT l_suppkey AS vendor_id, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS end_date, count(DISTINCT o_custkey) AS assignment_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)",
    "relations AS (SELECT vendor_id, CAST(application_id AS VARCHAR) AS application, string_agg(DISTINCT relation, '+' ORDER BY relation) AS relation FROM bridge GROUP BY 1, 2)",
]


def _shared_sql(kind):
    return f"coalesce(string_agg(key, ',' ORDER BY key) FILTER (kind = '{kind}'), '') AS shared_{kind}s"


def _texts(found, *relations):
    for kind in overlap.KINDS:
        found = found.withColumn(f"shared_{kind}s", F.array_join(f"shared_{kind}s", ","))
    return found.withColumns({r: F.array_join(r, ",") for r in relations})


@query("overlap_groups", with_sql(KEYS, GROUPS) + "SELECT * FROM groups")
def overlap_groups(spark, folder):
    return overlap.overlap_groups(keys(spark, folder))


@query("overlap_members", with_sql(KEYS, GROUPS) + "SELECT vendor_id, kind, key FROM keys JOIN groups USING (kind, key)")
def overlap_members(spark, folder):
    index = keys(spark, folder)
    return overlap.overlap_members(index, overlap.overlap_groups(index)).select("vendor_id", "kind", "key")


@query(
    "overlap_pairs",
    with_sql(
        KEYS,
        *CONTEXT,
        "shared AS (SELECT organization_id, a.vendor_id AS vendor_a, b.vendor_id AS vendor_b, kind, key FROM keys a JOIN keys b USING (organization_id, kind, key) WHERE a.vendor_id < b.vendor_id)",
        f"pairs AS (SELECT organization_id, vendor_a, vendor_b, {', '.join(map(_shared_sql, overlap.KINDS))} FROM shared GROUP BY 1, 2, 3)",
        "related AS (SELECT vendor_a, vendor_b, coalesce(string_agg(key || '=' || a.relation, ',' ORDER BY key), '') AS relations_a, coalesce(string_agg(key || '=' || b.relation, ',' ORDER BY key), '') AS relations_b FROM shared"
        " JOIN relations a ON a.vendor_id = vendor_a AND a.application = key JOIN relations b ON b.vendor_id = vendor_b AND b.application = key WHERE kind = 'application' GROUP BY 1, 2)",
    )
    + "SELECT pairs.*, coalesce(relations_a, '') AS relations_a, coalesce(relations_b, '') AS relations_b, "
    + ", ".join(
        f"CAST(f{x}.forecast AS VARCHAR) AS forecast_{x}, CAST(f{x}.budget AS VARCHAR) AS budget_{x}, t{x}.end_date AS end_date_{x}, t{x}.assignment_count AS assignment_count_{x}" for x in "ab"
    )
    + " FROM pairs LEFT JOIN related USING (vendor_a, vendor_b) "
    + " ".join(f"LEFT JOIN finance f{x} ON f{x}.vendor_id = vendor_{x} LEFT JOIN terms t{x} ON t{x}.vendor_id = vendor_{x}" for x in "ab"),
)
def overlap_pairs(spark, folder):
    """The candidates inside every organization, with what each side brings."""
    pairs = overlap.overlap_pairs(keys(spark, folder), ["organization_id"], pair_context(spark, folder))
    both = {f"relations_{x}": overlap.relations_of(F.col("shared_applications"), F.col(f"relations_{x}")) for x in "ab"}
    return _texts(pairs.withColumns(both), *both)


@query(
    "overlap_for_vendor",
    with_sql(KEYS, *CONTEXT, f"own AS (SELECT kind, key FROM keys WHERE vendor_id = {VENDOR})", f"others AS (SELECT * FROM keys JOIN own USING (kind, key) WHERE vendor_id <> {VENDOR})")
    + f"SELECT vendor_id, any_value(organization_id) = (SELECT s_nationkey FROM supplier WHERE s_suppkey = {VENDOR}) AS same_organization, {', '.join(map(_shared_sql, overlap.KINDS))},"
    " coalesce(string_agg(key || '=' || relation, ',' ORDER BY key) FILTER (kind = 'application'), '') AS relations, CAST(any_value(forecast) AS VARCHAR) AS forecast, CAST(any_value(budget) AS VARCHAR) AS budget,"
    " any_value(end_date) AS end_date, any_value(assignment_count) AS assignment_count FROM others LEFT JOIN finance USING (vendor_id) LEFT JOIN terms USING (vendor_id)"
    " LEFT JOIN relations ON relations.vendor_id = others.vendor_id AND application = key GROUP BY others.vendor_id",
)
def overlap_for_vendor(spark, folder):
    """Counterparts of one vendor in the whole portfolio, each with its own figures."""
    found = overlap.with_context(overlap.overlap_for_vendor(keys(spark, folder), VENDOR), {"vendor_id": ""}, pair_context(spark, folder))
    known = vendors(spark, folder).select("vendor_id", "organization_id")
    own = known.filter(F.col("vendor_id") == VENDOR).select(F.col("organization_id").alias("_own"))
    found = found.join(known, "vendor_id").withColumn("same_organization", F.col("organization_id") == own.scalar()).drop("organization_id")
    return _texts(found.withColumn("relations", overlap.relations_of(F.col("shared_applications"), F.col("relations"))), "relations")


# -------------------------------------------------------------------- dashboard
def dashboard_lines(spark, folder):
    """Contract lines of the dashboard: order totals by scenario, the owner's assessment and latest measurement."""
    money = spend_lines(spark, folder, None).groupBy("contract_id").agg(
        cents(F.sum("budget")).alias("budget"), cents(F.sum("forecast")).alias("forecast"), cents(F.sum(F.when(F.col("month") <= q_spend.COMPARABLE_MONTHS, F.col("actual")))).alias("actual_ytd")
    )
    latest = (
        q_risk.measured(spark, folder).groupBy("vendor_id").agg(F.max_by(F.struct("period", "actual", "target", "breach"), F.col("period")).alias("m"))
        .select("vendor_id", F.col("m.period").alias("sla_period"), F.col("m.actual").alias("sla_actual"), F.col("m.target").alias("sla_target"), F.col("m.breach").alias("sla_breach"))
    )
    owners = assessments(spark, folder).select("vendor_id", F.col("status").alias("risk_status"), F.col("tier").alias("risk_tier"))
    records = contracts(spark, folder).select("contract_id", "vendor_id", "end_date").join(money, "contract_id", "left")
    return dashboard.dashboard_contracts(records, renewal_terms(spark, folder), AS_OF, [owners, latest])


DASHBOARD = [
    CONTRACTS, RENEWAL_TERMS, MEASUREMENTS, q_risk.MEASURED, ASSESSMENTS, spend_lines_sql(None, "all_lines"),
    f"money AS (SELECT contract_id, {cents_sql('sum(budget)')} AS budget, {cents_sql('sum(forecast)')} AS forecast, {cents_sql('sum(CASE WHEN month <= 8 THEN actual END)')} AS actual_ytd FROM all_lines GROUP BY 1)",
    "latest AS (SELECT vendor_id, period AS sla_period, actual AS sla_actual, breach AS sla_breach FROM measured QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY period DESC) = 1)",
    f"board AS (SELECT c.contract_id, c.vendor_id, c.end_date, budget, forecast, actual_ytd, status AS risk_status, CASE WHEN coalesce(status, '') <> 'Missing' THEN tier END AS risk_tier, sla_period, sla_actual,"
    f" CASE WHEN sla_period IS NOT NULL THEN '{q_risk.TARGET}.0000' END AS sla_target, coalesce(sla_breach, FALSE) AS sla_breach, notice_days, automatic_renewal, notice_deadline, end_date - DATE '{AS_OF}' AS days_to_expiry,"
    f" notice_deadline - DATE '{AS_OF}' AS days_to_decision, {ATTENTION_SQL} AS attention, CASE WHEN budget <> 0 THEN CAST(forecast - budget AS DECIMAL(18,2)) END AS forecast_variance_amount,"
    f" {percent_sql('(forecast - budget)', 'budget')} AS forecast_variance_pct FROM (SELECT contract_id, vendor_id, end_date FROM contracts) c LEFT JOIN money USING (contract_id) LEFT JOIN assessments USING (vendor_id)"
    " LEFT JOIN latest USING (vendor_id) LEFT JOIN renewal_terms USING (contract_id))",
]


@query(
    "dashboard_contracts",
    with_sql(*DASHBOARD)
    + "SELECT contract_id, vendor_id, CAST(end_date AS VARCHAR) AS end_date, CAST(budget AS VARCHAR) AS budget, CAST(forecast AS VARCHAR) AS forecast, CAST(actual_ytd AS VARCHAR) AS actual_ytd, risk_status, risk_tier, sla_period,"
    " CAST(sla_actual AS VARCHAR) AS sla_actual, sla_target, sla_breach, notice_days, automatic_renewal, CAST(notice_deadline AS VARCHAR) AS renewal_decision_date, days_to_expiry, days_to_decision, attention,"
    " CAST(forecast_variance_amount AS VARCHAR) AS forecast_variance_amount, CAST(CAST(forecast_variance_pct AS DECIMAL(18,2)) AS VARCHAR) AS forecast_variance_pct FROM board",
)
def dashboard_contracts(spark, folder):
    return dashboard_lines(spark, folder)


_REASONS = (
    "list_filter([CASE WHEN attention = 'past_notice' THEN 'Renewal notice deadline passed on ' || notice_deadline END, CASE WHEN attention = 'notice_due' THEN 'Renewal decision due ' || notice_deadline || ' (' || days_to_decision || ' days)' END,"
    " CASE WHEN attention = 'expiring' THEN 'Contract expires ' || end_date || ' (' || days_to_expiry || ' days)' END, CASE WHEN sla_breach THEN 'SLA breach in ' || sla_period || ': ' || sla_actual || '% against a ' || sla_target || '% target' END,"
    " CASE WHEN risk_tier IN ('High', 'Critical') THEN 'Contract risk tier: ' || risk_tier END, CASE WHEN risk_status <> 'Current' THEN 'Risk assessment is ' || lower(risk_status) END,"
    " CASE WHEN forecast_variance_pct > 5 THEN 'forecast is ' || CAST(forecast_variance_pct AS DECIMAL(18,2)) || '% over budget' END], lambda x: x IS NOT NULL)"
)
_ACTIONS = (
    "list_filter([CASE WHEN attention = 'past_notice' THEN 'Confirm the renewal position now that the notice deadline has passed.' END, CASE WHEN attention = 'notice_due' THEN 'Prepare the renewal decision before the notice deadline.' END,"
    " CASE WHEN attention = 'expiring' THEN 'Confirm whether the contract should be renewed before it expires.' END, CASE WHEN sla_breach THEN 'Start an SLA remediation review.' END,"
    " CASE WHEN risk_tier IN ('High', 'Critical') THEN 'Review the risk position and mitigations.' END, CASE WHEN risk_status <> 'Current' THEN 'Obtain a current risk assessment; no risk tier is inferred.' END,"
    " CASE WHEN forecast_variance_pct > 5 THEN 'Review spend against budget.' END], lambda x: x IS NOT NULL)"
)
REVIEW = (
    f"review AS (SELECT vendor_id, contract_id, CASE WHEN attention IN ('past_notice', 'expired') OR sla_breach OR coalesce(risk_tier IN ('High', 'Critical'), FALSE) OR coalesce(risk_status = 'Missing', FALSE) THEN 'high' ELSE 'medium' END AS priority,"
    f" {_REASONS} AS reasons, {_ACTIONS} AS actions FROM board)"
)


@query("review_queue", with_sql(*DASHBOARD, REVIEW) + "SELECT vendor_id, contract_id, priority, array_to_string(reasons, ' | ') AS reasons, array_to_string(actions, ' | ') AS actions, actions[1] AS headline FROM review WHERE len(reasons) > 0")
def review_queue(spark, folder):
    queue = dashboard.review_queue(dashboard_lines(spark, folder))
    return queue.withColumn("reasons", F.array_join("reasons", " | ")).withColumn("actions", F.array_join("actions", " | "))


@query(
    "dashboard_totals",
    with_sql(*DASHBOARD)
    + "SELECT count(DISTINCT vendor_id) AS vendors, count(*) AS contracts, count(*) FILTER (attention = 'past_notice') AS past_notice, count(*) FILTER (attention = 'notice_due') AS decisions_due,"
    " count(*) FILTER (days_to_expiry BETWEEN 0 AND 90) AS expiring, count(*) FILTER (risk_tier IN ('High', 'Critical')) AS high_risk, count(*) FILTER (risk_status = 'Missing') AS missing_assessment,"
    " count(*) FILTER (sla_breach) AS sla_breaches, count(*) FILTER (forecast_variance_pct > 0) AS over_budget, CAST(CAST(sum(budget) AS DECIMAL(18,2)) AS VARCHAR) AS budget, CAST(CAST(sum(forecast) AS DECIMAL(18,2)) AS VARCHAR) AS forecast,"
    f" CAST(CAST(sum(actual_ytd) AS DECIMAL(18,2)) AS VARCHAR) AS actual_ytd, {money_sql('sum(forecast) - sum(budget)')} AS forecast_variance_amount,"
    f" CAST(CAST({percent_sql('(CAST(sum(forecast) AS DECIMAL(18,2)) - CAST(sum(budget) AS DECIMAL(18,2)))', 'CAST(sum(budget) AS DECIMAL(18,2))')} AS DECIMAL(18,2)) AS VARCHAR) AS forecast_variance_pct FROM board",
)
def dashboard_totals(spark, folder):
    return dashboard.dashboard_totals(dashboard_lines(spark, folder))
