"""Contract queries: orders stand for contracts, customers for their owners, suppliers for vendors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.dates import days_until
from ledgerlens.operators import contracts as ops
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import AS_OF, CONTRACTS, RENEWAL_TERMS, VENDORS, contracts, renewal_terms, table, vendors, with_sql

ATTENTION_SQL = (
    f"CASE WHEN end_date < DATE '{AS_OF}' THEN 'expired' WHEN notice_deadline < DATE '{AS_OF}' THEN 'past_notice'"
    f" WHEN notice_deadline - DATE '{AS_OF}' <= 90 THEN 'notice_due' WHEN end_date - DATE '{AS_OF}' <= 90 THEN 'expiring' ELSE 'on_track' END"
)


@query("contracts_by_org", with_sql(VENDORS) + "SELECT * FROM vendors WHERE organization_id = 7")
def contracts_by_org(spark, folder):
    return ops.list_contracts(vendors(spark, folder), organization_id=7)


@query(
    "expiring_contracts",
    with_sql(CONTRACTS)
    + "SELECT contract_id, vendor_id, CAST(contract_value AS VARCHAR) AS contract_value, CAST(end_date AS VARCHAR) AS end_date, status, priority,"
    f" end_date - DATE '{AS_OF}' AS days_to_expiry FROM contracts WHERE end_date - DATE '{AS_OF}' BETWEEN 0 AND 60",
)
def expiring_contracts(spark, folder):
    return ops.expiring_contracts(contracts(spark, folder), AS_OF, 60)


@query(
    "vendor_dimensions",
    "SELECT DISTINCT vendor_id, dimension, value FROM (SELECT l_suppkey AS vendor_id, 'product' AS dimension, p_brand AS value FROM lineitem JOIN part ON l_partkey = p_partkey"
    " UNION ALL SELECT l_suppkey, 'service', p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
    " UNION ALL SELECT s_suppkey, 'organization', CAST(s_nationkey AS VARCHAR) FROM supplier)",
)
def vendor_dimensions(spark, folder):
    used = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), "l_partkey").distinct()
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"), F.col("p_type").alias("service"))
    offered = ops.dimension_values(used.join(parts, "l_partkey"), "vendor_id", ["product", "service"])
    owned = ops.dimension_values(vendors(spark, folder).withColumnRenamed("organization_id", "organization"), "vendor_id", ["organization"])
    return offered.unionByName(owned)


@query("renewal_terms", with_sql(CONTRACTS, RENEWAL_TERMS) + "SELECT contract_id, clause_class, notice_days, CAST(notice_deadline AS VARCHAR) AS notice_deadline, automatic_renewal FROM renewal_terms")
def terms(spark, folder):
    return renewal_terms(spark, folder)


@query(
    "attention_state",
    with_sql(CONTRACTS, RENEWAL_TERMS)
    + f"SELECT contract_id, CAST(end_date AS VARCHAR) AS end_date, CAST(notice_deadline AS VARCHAR) AS notice_deadline, {ATTENTION_SQL} AS attention FROM contracts LEFT JOIN renewal_terms USING (contract_id)",
)
def attention(spark, folder):
    joined = contracts(spark, folder).select("contract_id", "end_date").join(renewal_terms(spark, folder).select("contract_id", "notice_deadline"), "contract_id", "left")
    return joined.withColumn("attention", ops.attention_state(F.col("end_date"), F.col("notice_deadline"), AS_OF))


@query(
    "past_notice",
    with_sql(CONTRACTS, RENEWAL_TERMS)
    + "SELECT contract_id, CAST(end_date AS VARCHAR) AS end_date, CAST(notice_deadline AS VARCHAR) AS notice_deadline, notice_days FROM contracts JOIN renewal_terms USING (contract_id)"
    f" WHERE end_date >= DATE '{AS_OF}' AND notice_deadline < DATE '{AS_OF}'",
)
def past_notice(spark, folder):
    return ops.past_notice(contracts(spark, folder), renewal_terms(spark, folder), AS_OF).select("contract_id", "end_date", "notice_deadline", "notice_days")


@query(
    "renewal_priority",
    with_sql(CONTRACTS, "critical AS (SELECT l_orderkey AS contract_id, count(DISTINCT l_partkey) AS critical_applications FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 45 AND l_returnflag <> 'R' GROUP BY 1)")
    + f"SELECT contract_id, end_date - DATE '{AS_OF}' AS days_to_expiry, coalesce(critical_applications, 0) AS critical_applications,"
    f" CASE WHEN end_date - DATE '{AS_OF}' BETWEEN 0 AND 120 AND coalesce(critical_applications, 0) > 0 THEN 'High' WHEN end_date - DATE '{AS_OF}' BETWEEN 0 AND 120 THEN 'Review' ELSE 'Monitor' END AS priority"
    " FROM contracts LEFT JOIN critical USING (contract_id)",
)
def renewal_priority(spark, folder):
    critical_parts = table(spark, folder, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("l_partkey"))
    critical = (
        table(spark, folder, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("contract_id"), "l_partkey")
        .join(critical_parts, "l_partkey", "left_semi").groupBy("contract_id").agg(F.countDistinct("l_partkey").alias("critical_applications"))
    )
    joined = contracts(spark, folder).select("contract_id", "end_date").join(critical, "contract_id", "left").fillna(0, ["critical_applications"])
    return joined.select(
        "contract_id", days_until(F.col("end_date"), AS_OF).alias("days_to_expiry"), "critical_applications",
        ops.renewal_priority(F.col("end_date"), F.col("critical_applications"), AS_OF).alias("priority"),
    )


@query(
    "effective_dated_join",
    "SELECT l.l_orderkey AS contract_id, l.l_linenumber AS line_number, l.l_partkey AS application_id, o.o_custkey AS owner_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
    " WHERE CAST(l.l_shipdate AS DATE) BETWEEN CAST(o.o_orderdate AS DATE) AND CAST(o.o_orderdate AS DATE) + 30",
)
def effective_dated_join(spark, folder):
    """Lines that fall inside the first thirty days of their contract."""
    facts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("application_id"), F.col("l_shipdate").cast("date").alias("at")
    )
    crosswalk = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").cast("date").alias("effective_from"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("effective_to"),
    )
    return ops.effective_join(facts, crosswalk, ["contract_id"], "at").select("contract_id", "line_number", "application_id", "owner_id")
